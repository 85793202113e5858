"""Structured Streaming: cleaning as documents arrive, hourly event windows with a watermark, running budgets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators.shared import shared_dir


def work_dir(spark: SparkSession) -> str:
    """A new folder in the one that all executors share."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def cleaned(docs: DataFrame) -> DataFrame:
    """Stateless cleaning of a stream (or table) of documents."""
    step = docs.select("doc_id", "source", T.strip_boilerplate(F.col("text")).alias("b")).select("doc_id", "source", "b.status", T.strip_front_matter(F.col("b.text")).alias("f"))
    return step.select("doc_id", "source", "status", T.normalise(F.col("f.text")).alias("text"))


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Count and sum by hour and type; an hour is final once the watermark has passed its end."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    windowed = timed.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return windowed.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def run_available(stream: DataFrame, where: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now into Parquet files, and read these."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{where}/out")


def from_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream source."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    folder = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
    # A file source lists a folder; where a table is one file, its name picks it.
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if folder else f"{name}.parquet")
    return source.parquet(path if folder else sf_dir)
