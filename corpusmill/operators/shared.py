"""Tables written to the folder that all executors share, and broadcasts behind a count."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are broadcast at most, where nothing else bounds them.
BROADCAST_ROWS = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where none is set, a folder of our own on a local master, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "corpusmill-checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def written(df: DataFrame) -> DataFrame:
    """Computed once and read again from the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` as a broadcast side if it has at most ``rows`` rows, else as it is: joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of ``df`` has."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        free = next(x for x in (name, *(f"{name}_{k}" for k in range(len(taken) + len(names) + 1))) if x.lower() not in taken)
        taken.add(free.lower())
        found.append(free)
    return found
