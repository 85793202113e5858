"""Sinks: JSON lines and separator text that drop blanks, content digests, guarded and append-only writes."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import SEPARATOR, blank


def write_documents(docs: DataFrame, path: str, text_col: str = "text", overwrite: bool = False) -> int:
    """One JSON object {"text": ...} a line; null and blank texts are left out. Returns how many were written. An
    existing path is refused unless ``overwrite``, before any work."""
    kept = docs.where(~blank(F.col(text_col))).select(F.col(text_col).alias("text"))
    kept.write.mode("overwrite" if overwrite else "errorifexists").json(path)
    return docs.sparkSession.read.schema("text string").json(path).count()


def write_separated(docs: DataFrame, path: str, order: str, text_col: str = "text") -> None:
    """Documents as text, each ended by a separator line and an empty line, in ranges of ``order``."""
    ranged = docs.repartitionByRange(order).sortWithinPartitions(order)
    ranged.select(F.concat(F.col(text_col), F.lit(f"\n{SEPARATOR}\n")).alias("value")).write.text(path)


def append_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def content_digest(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row (n, digest) that does not depend on order or partitioning: counts and sums of row hashes."""
    h = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    part = lambda k: F.conv(F.substring(h, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")
    return docs.agg(F.count("*").alias("n"), F.md5(F.concat_ws("-", *[F.sum(part(k)).cast("string") for k in range(4)])).alias("digest"))


def assert_not_protected(path: str, protected: list[str]) -> None:
    """Refuse to write at or below a protected folder."""
    real = os.path.realpath(path)
    for p in map(os.path.realpath, protected):
        if real == p or real.startswith(p + os.sep):
            raise PermissionError(f"{path} lies in protected {p}")
