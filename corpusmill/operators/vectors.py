"""Vectors: exact nearest neighbours in blocks of queries, sums, Gram matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Queries that are sent to all tasks at once; more are taken in further passes.
BLOCK_ROWS = 4096


def unit(v: Column) -> Column:
    """The array divided by its length, which counts as 1e-12 at least."""
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(d, lambda x: x / F.greatest(norm, F.lit(1e-12)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.array(rows, np.float64).reshape(len(rows), -1)


def neighbours(points: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, neighbour, sim, rank): the ``k`` points of largest cosine for each query, itself excluded, exact.

    Both have (id, v). Queries are read in blocks of ids; a block is compared with each batch of points in its task
    and only the best k of a batch go on, so nothing quadratic is shuffled. Similarities are rounded to 9 places,
    equal ones ranked by id.
    """
    # Blocks by a hash of the id: about half full, so that none is likely to pass the bound.
    n = queries.count()
    blocks = max(1, -(-2 * n // block_rows)) if n > block_rows else 1
    found = None
    for k_block in range(blocks if n else 0):
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k_block).orderBy("id").collect()
        near = _near(points, [r["id"] for r in rows], np.array([r["v"] for r in rows], np.float64), k)
        found = near if found is None else found.unionByName(near)
    if found is None:
        return points.sparkSession.createDataFrame([], "id long, neighbour long, sim double, rank int")
    rank = F.row_number().over(W.partitionBy("id").orderBy(F.col("sim").desc(), "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _near(points: DataFrame, ids: list[int], vectors: np.ndarray, k: int) -> DataFrame:
    vectors = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    shared = points.sparkSession.sparkContext.broadcast((np.array(ids, np.int64), vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.asarray(batch.column("id").to_numpy(zero_copy_only=False), np.int64)
            x = _matrix(batch.column("v"))
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            sim = np.round(q @ x.T, 9)
            sim[ids[:, None] == own[None, :]] = -np.inf
            for a in range(0, len(ids), 256):
                part = sim[a : a + 256]
                order = np.lexsort((np.broadcast_to(own, part.shape), -part), axis=1)[:, :k]
                best = np.take_along_axis(part, order, axis=1)
                ok = np.isfinite(best)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[a : a + 256], ok.sum(axis=1))), pa.array(own[order][ok]), pa.array(best[ok])], names=["id", "neighbour", "sim"])

    return points.select("id", "v").mapInArrow(run, "id long, neighbour long, sim double")


def vector_sums(points: DataFrame, key: str) -> DataFrame:
    """(key, n, total): the element-wise sum of unit vectors of each key, summed place by place before the shuffle."""
    places = points.select(key, F.posexplode("u").alias("i", "x")).groupBy(key, "i").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    rows = F.array_sort(F.collect_list(F.struct("i", "x")))
    return places.groupBy(key).agg(F.max("n").alias("n"), F.transform(rows, lambda r: r["x"]).alias("total"))


def gram(points: DataFrame, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, sums and the matrix of summed products: width squared numbers, whatever the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            if batch.num_rows:
                x = np.c_[_matrix(batch.column("v")), np.ones(batch.num_rows)]
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "x"])

    cells = points.select("v").mapInArrow(run, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect()
    total = np.zeros((width + 1) ** 2)
    for r in cells:
        total[r["cell"]] = r["x"]
    total = total.reshape(width + 1, width + 1)
    return int(round(total[width, width])), total[width, :width], total[:width, :width]


def hops(a: Column, b: Column, w: int, h: int, torus: bool = True) -> Column:
    """Grid distance of cells numbered row by row."""
    dx, dy = F.abs(a % w - b % w), F.abs(F.floor(a / w) - F.floor(b / w))
    return (F.least(dx, w - dx) + F.least(dy, h - dy) if torus else dx + dy).cast("long")
