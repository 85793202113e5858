"""Seeded sampling by hashes: windows, bootstrap floors, topological draws. The same key gives the same draw anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.operators.vectors import hops


def uniform(*key: Column) -> Column:
    """A number between 0 and 1 from the first 32 bits of an md5."""
    text = F.concat_ws("-", *[k.cast("string") for k in key])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def windows(ids: DataFrame, key: str, array: str, length: int, n: int) -> DataFrame:
    """(key, window, x, y): ``n`` windows of each array at hashed starts, y one place on. Too short arrays raise."""
    room = F.size(array) - length - 1
    checked = F.when(room <= 0, F.raise_error(F.lit(f"an array has no window of {length}")).cast("int")).otherwise(room)
    starts = ids.select(key, array, checked.alias("_room"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("window"))
    start = F.floor(uniform(F.lit("w"), F.col(key), F.col("window")) * F.col("_room")).cast("int")
    return starts.select(key, "window", F.slice(array, start + 1, F.lit(length)).alias("x"), F.slice(array, start + 2, F.lit(length)).alias("y"))


def cumulative(p: DataFrame) -> DataFrame:
    """(cell, p) with lo and hi, the cell's stretch of the unit interval in the order of cells. One row a cell."""
    w = W.partitionBy(F.lit(0)).orderBy("cell")
    return p.withColumn("hi", F.sum("p").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("lo", F.col("hi") - F.col("p"))


def bootstrap_floor(spark: SparkSession, p: DataFrame, n_draws: int, trials: int) -> DataFrame:
    """(trial, tv): total variation distance between ``p`` (cell, p) and ``n_draws`` draws from it."""
    draws = spark.range(trials).withColumnRenamed("id", "trial").crossJoin(spark.range(n_draws)).withColumn("u", uniform(F.lit("b"), F.col("trial"), F.col("id")))
    cells = F.broadcast(cumulative(p))  # one row a cell
    hit = draws.join(cells, (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).groupBy("trial", "cell").agg((F.count("*") / n_draws).alias("q"))
    every = spark.range(trials).withColumnRenamed("id", "trial").crossJoin(F.broadcast(p))
    return every.join(hit, ["trial", "cell"], "left").groupBy("trial").agg((F.sum(F.abs(F.coalesce("q", F.lit(0.0)) - F.col("p"))) / 2).alias("tv"))


def topological_draw(logits: DataFrame, cell_lse: DataFrame, draws: int, width: int, height: int, reach: int) -> DataFrame:
    """(draw, origin, id): a cell drawn by its log-sum-exp, then a point within ``reach`` hops of it by its logit.

    Both draws take the largest of logits with Gumbel noise. ``logits`` has (id, cell, x), ``cell_lse`` (cell, lse).
    """
    spark = logits.sparkSession
    noise = lambda *key: -F.ln(-F.ln(uniform(*key)))
    numbers = F.broadcast(spark.range(draws).withColumnRenamed("id", "draw"))
    scored = cell_lse.crossJoin(numbers).withColumn("s", F.col("lse") + noise(F.lit("c"), F.col("draw"), F.col("cell")))
    origin = F.broadcast(scored.groupBy("draw").agg(F.max_by("cell", "s").alias("origin")))  # one row a draw
    near = logits.join(origin, hops(F.col("cell"), F.col("origin"), width, height) <= reach)
    return near.withColumn("s", F.col("x") + noise(F.lit("t"), F.col("draw"), F.col("id"))).groupBy("draw", "origin").agg(F.max_by("id", "s").alias("id"))
