"""A registry for one module's queries, and SQL shared by the oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Deterministic dirt by doc_id: markers, credits, carriage returns. The same expression runs on both sides.
DIRTY = """CASE doc_id % 5
 WHEN 0 THEN concat('*** START OF THE PROJECT GUTENBERG EBOOK X ***', chr(10), chr(10), text, chr(10), '*** END OF THIS PROJECT GUTENBERG EBOOK X ***', chr(10), 'tail')
 WHEN 1 THEN replace(text, '. ', concat('.  ', chr(13), chr(10), chr(13), chr(10), chr(10)))
 WHEN 2 THEN concat('Produced by David Price', chr(10), chr(10), text)
 WHEN 3 THEN concat(chr(10), 'produced by charity alone', chr(10), text, '  ')
 ELSE concat('*** START OF THIS PROJECT GUTENBERG ETEXT Y ***', chr(10), 'Transcribed from the first edition', chr(10), 'x.y@example.org', chr(10), text) END"""


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Register a function of (spark, sf_dir) under its name, with its SQL if there is one."""

        def add(run):
            self.queries[run.__name__] = run
            if sql is not None:
                self.oracle[run.__name__] = sql
            return run

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(words: list[str]) -> str:
    """A SQL list of strings."""
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
