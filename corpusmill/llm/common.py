"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text that one numpy working set covers; more rows of a batch go to the next set.
SHARD_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Where none is set, one of our own on a local master,
    else an error: executors of a cluster do not see each other's folders."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "corpusmill-checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through files in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints that nothing refers to: it does when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_volume(docs: DataFrame, text_col: str) -> int:
    """Bytes of text in all rows, for sizing partitions. One scan, a sum."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).first()["n"]


def pieces_of(batches: Iterator[pa.RecordBatch], column: str, most: int = SHARD_BYTES) -> Iterator[pa.RecordBatch]:
    """Re-cut batches so that ``column`` holds about ``most`` bytes in each; a longer single value stands alone."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
    release()


def release() -> None:
    """Give memory that a task has freed back to the system: its worker waits for the next task, beside the JVM."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def utf8_values(column: pa.Array) -> list[bytes]:
    """The values as UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def grouped_blobs(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """Rows of equally long arrays packed column after column, one blob for each bucket."""
    order = np.argsort(bucket, kind="stable")
    keys = bucket[order]
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    ends = np.r_[cuts[1:], len(keys)][: len(cuts)]
    sorted_columns = [c[order] for c in columns]
    for a, b in zip(cuts.tolist(), ends.tolist(), strict=True):
        yield int(keys[a]), b"".join(c[a:b].tobytes() for c in sorted_columns)


def unpack_blobs(blobs: list[bytes], dtypes: list) -> list[np.ndarray]:
    """The inverse of grouped_blobs for blobs of one bucket."""
    width = sum(np.dtype(t).itemsize for t in dtypes)
    parts: list[list[np.ndarray]] = [[] for _ in dtypes]
    for blob in blobs:
        n, at = len(blob) // width, 0
        for k, t in enumerate(dtypes):
            parts[k].append(np.frombuffer(blob, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(p) if p else np.empty(0, t) for p, t in zip(parts, dtypes, strict=True)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
