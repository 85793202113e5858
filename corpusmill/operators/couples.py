"""Couples of words that stand in one set: counts and best partners, without a row for each couple of each set.

Words are numbered from the rarest to the most common. A set is sent as numbers to the buckets of its words, whole or from
its first word of the bucket on, and a bucket counts the couples of its words in numpy, COUPLES_AT_ONCE at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.shared import small, written

#: Couples meant for one bucket (each once from sets sent in part, twice from whole ones); couples and numbers held at once within a task.
BUCKET_COUPLES, COUPLES_AT_ONCE = 1 << 23, 1 << 20


class Numbered:
    """``words`` (w, id, c): all words by number, with the sets that hold them. ``sets`` (row, ids, times): numbers in order."""

    def __init__(self, sets: DataFrame):
        """``sets`` has (row, words), an array of (w, times) structs, each word once; null and empty sets are left out."""
        each = sets.select("row", F.inline("words"))
        ranked = each.groupBy("w").agg(F.count("*").alias("c")).repartitionByRange("c", "w").sortWithinPartitions("c", "w")
        ranked = written(ranked.withColumn("at", F.monotonically_increasing_id()))
        part = F.shiftright("at", 33).cast("int")
        firsts, n = {}, 0
        for r in sorted(ranked.groupBy(part.alias("part")).count().collect()):
            firsts[r["part"]], n = n, n + r["count"]
        first = F.element_at(F.array(*[F.lit(firsts.get(k, 0)) for k in range(max(firsts, default=0) + 1)]), part + 1)
        self.words = ranked.select("w", (F.col("at").bitwiseAND((1 << 33) - 1) + first).cast("int").alias("id"), "c")
        times = sorted((r["c"], r["count"]) for r in ranked.groupBy("c").count().collect())
        #: Counts by number, as runs: numbers are in the order of counts.
        self.counts = np.array([c for c, _ in times], np.int64), np.array([k for _, k in times], np.int64)
        coded = each.join(small(self.words.select("w", "id")), "w").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("id", "times"))).alias("x"))
        self.sets = written(coded.select("row", F.col("x.id").alias("ids"), F.col("x.times").alias("times")))

    def dealt(self, whole: bool) -> DataFrame:
        """Rows (bucket, buckets, blob): sets in the buckets of their words."""
        total = self.sets.agg(F.coalesce(F.sum(F.size("ids").cast("long") * (F.size("ids") - 1)), F.lit(0)).alias("n")).first()["n"]
        buckets = max(12, -(-total // (2 * BUCKET_COUPLES)))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = np.asarray(batch.column("ids").value_lengths()).astype(np.int64)
                ends = np.cumsum(sizes * np.minimum(sizes, buckets))
                at = 0
                while at < len(sizes):
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COUPLES_AT_ONCE, side="right")))
                    yield some(batch.slice(at, to - at))
                    at = to

        def some(batch: pa.RecordBatch) -> pa.RecordBatch:
            row = np.asarray(batch.column("row"), np.int64)
            sizes = np.asarray(batch.column("ids").value_lengths()).astype(np.int64)
            ids, times = (np.asarray(batch.column(c).flatten(), np.int32) for c in ("ids", "times"))
            ends = np.cumsum(sizes)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            # The first word of each (bucket, set); words of a set are in order.
            _, head = np.unique(bucket_of(ids, buckets) * len(sizes) + owner, return_index=True)
            key, of = bucket_of(ids[head], buckets), owner[head]
            start = ends[of] - sizes[of] if whole else head
            n = ends[of] - start
            cuts = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[: len(key)], len(key)]
            blobs = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                take = spans(start[a:b], n[a:b])
                blobs.append(packed(row[of[a:b]], n[a:b], ids[take], times[take] if whole else None))
            return pa.RecordBatch.from_arrays([pa.array(key[cuts[:-1]], pa.int64()), pa.array(np.full(len(blobs), buckets), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "buckets", "blob"])

        return self.sets.mapInArrow(deal, "bucket long, buckets long, blob binary")


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of n each, one span after the other."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers byte plane by byte plane, which compresses."""
    return x.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def packed(row: np.ndarray, n: np.ndarray, ids: np.ndarray, times: np.ndarray | None) -> bytes:
    """Numbers as steps; of times a bit each, and what is above 0."""
    steps = np.diff(ids, prepend=np.int32(0))
    some = np.empty(0, np.int32) if times is None else times[times > 0]
    bits = b"" if times is None else np.packbits(times > 0).tobytes()
    return np.int64([len(row), len(ids), len(some)]).tobytes() + row.astype("<i8").tobytes() + planes(n) + planes(steps) + planes(some) + bits


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, n, ids, times) of a blob; times are 0 where it has none."""
    rows, k, some = np.frombuffer(blob, np.int64, 3).tolist()
    ends = np.cumsum([24, 8 * rows, 4 * rows, 4 * k, 4 * some]).tolist()
    n, steps, above = (np.ascontiguousarray(np.frombuffer(blob, np.uint8, 4 * m, at).reshape(4, m).T).view("<i4").ravel() for at, m in zip(ends[1:], (rows, k, some), strict=False))
    times = np.zeros(k, np.int32)
    if some:
        times[np.unpackbits(np.frombuffer(blob, np.uint8, -1, ends[4]), count=k).astype(bool)] = above
    return np.frombuffer(blob, np.int64, rows, 24), n, np.cumsum(steps, dtype=np.int32), times


class Cell:
    """All sets of one bucket: row, n and end of each; ids and whether times are above 0 (more) of each word; of the bucket's
    own words their place (mine), set (own) and times."""

    def __init__(self, key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]):
        parts: list[list[np.ndarray]] = [[np.empty(0, t)] for t in (np.int64, np.int32, np.int32, bool, np.int64, np.int32)]
        at = 0
        for batch in group:
            for blob in batch.column("blob"):
                row, n, ids, times = unpacked(blob.as_py())
                mine = np.flatnonzero(bucket_of(ids, key[1].as_py()) == key[0].as_py())
                for part, x in zip(parts, (row, n, ids, times > 0, mine + at, times[mine]), strict=True):
                    part.append(x)
                at += len(ids)
        self.row, self.n, self.ids, self.more, self.mine, self.times = (np.concatenate(x) for x in parts)
        self.end = np.cumsum(self.n, dtype=np.int64)
        self.own = np.searchsorted(self.end, self.mine, side="right")


def by_word(ids: np.ndarray, cost: np.ndarray) -> Iterator[np.ndarray]:
    """Places of ``ids``, by word; parts of about COUPLES_AT_ONCE in cost, all places of a word in one part."""
    order = np.argsort(ids, kind="stable")
    if not len(order):
        return
    ends = np.cumsum(cost[order])
    last = np.r_[np.flatnonzero(ids[order][1:] != ids[order][:-1]), len(order) - 1]
    at, done = 0, 0
    while at < len(order):
        k = int(np.searchsorted(ends[last], done + COUPLES_AT_ONCE, side="right"))
        to = last[max(k - 1, int(np.searchsorted(last, at)))] + 1
        yield order[at:to]
        at, done = to, ends[to - 1]


def pieces(places: np.ndarray, cost: np.ndarray) -> Iterator[np.ndarray]:
    """Places cut into runs of about COUPLES_AT_ONCE in cost."""
    part = np.cumsum(cost[places]) // COUPLES_AT_ONCE
    cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
    yield from (x for x in np.split(places, cuts) if len(x))


def summed(code: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and how often each stands."""
    if n is None:
        code = np.sort(code)
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
        return code[first], np.diff(np.r_[first, len(code)])
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
    return code[first], np.add.reduceat(n, first) if len(first) else n


def couples_of(places: np.ndarray, cost: np.ndarray, code) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of the couples at these places, and their counts; a part at a time where one word has very many."""
    found = [summed(code(x)) for x in pieces(places, cost)]
    return found[0] if len(found) == 1 else summed(np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found]))


def couple_counts(numbered: Numbered) -> DataFrame:
    """Rows (x, y, n_ab, n_x, n_y): numbers of every two words of one set, x the smaller, sets that hold both, or either."""
    values, runs = numbered.counts

    def count(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count_of = np.repeat(values, runs)
        c = Cell(key, group)
        left = c.end[c.own] - c.mine - 1

        def code(at: np.ndarray) -> np.ndarray:
            return np.repeat(c.ids[c.mine[at]].astype(np.int64) << 32, left[at]) | c.ids[spans(c.mine[at] + 1, left[at])]

        for places in by_word(c.ids[c.mine], left):
            found, times = couples_of(places, left, code)
            x, y = found >> 32, found & 0xFFFFFFFF
            for at in range(0, len(x), 1 << 17):
                a, b, t = (v[at : at + (1 << 17)] for v in (x, y, times))
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (a.astype(np.int32), b.astype(np.int32), t.astype(np.int64), count_of[a], count_of[b])], names=["x", "y", "n_ab", "n_x", "n_y"])

    return numbered.dealt(whole=False).groupBy("bucket", "buckets").applyInArrow(in_batches(count), "x int, y int, n_ab long, n_x long, n_y long")


def best_partners(numbered: Numbered, n: int) -> DataFrame:
    """Rows (row, total): of each set, its words with ``times`` above 0, each its times by its best score (NPMI within 0 and 1 over
    ``n`` sets) with a word of the set whose times are 0."""
    values, runs = numbered.counts

    def score(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = np.repeat(values, runs) / n
        c = Cell(key, group)
        size = c.n[c.own].astype(np.int64)
        first, word, total = c.end[c.own] - size, c.ids[c.mine].astype(np.int64) << 32, np.zeros(len(c.row))

        def code(at: np.ndarray) -> np.ndarray:
            return np.repeat(word[at], size[at]) | c.ids[spans(first[at], size[at])]

        for places in by_word(c.ids[c.mine], size):
            if not (c.times[places] > 0).any():
                continue
            found, both = couples_of(places, size, code)
            # Scores of distinct couples; those of a word with itself are never asked.
            p = both / n
            with np.errstate(divide="ignore", invalid="ignore"):
                s = np.where(both < n, np.maximum(0.0, np.log(p / (share[found >> 32] * share[found & 0xFFFFFFFF])) / -np.log(p)), 0.0)
            for at in pieces(places[c.times[places] > 0], size):
                asked, whose = spans(first[at], size[at]), np.repeat(np.arange(len(at)), size[at])
                before = ~c.more[asked]
                asked, whose = asked[before], whose[before]
                got = s[np.searchsorted(found, word[at][whose] | c.ids[asked])]
                head = np.flatnonzero(np.r_[True, whose[1:] != whose[:-1]][: len(whose)])
                if len(head):
                    at = at[whose[head]]
                    np.add.at(total, c.own[at], c.times[at] * np.maximum.reduceat(got, head))
        yield pa.RecordBatch.from_arrays([pa.array(c.row), pa.array(total)], names=["row", "total"])

    found = numbered.dealt(whole=True).groupBy("bucket", "buckets").applyInArrow(in_batches(score), "row long, total double")
    return found.groupBy("row").agg(F.sum("total").alias("total"))


def in_batches(run):
    """``run`` with the annotations by which Spark passes a group as batches."""

    def call(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(key, group)
        pa.default_memory_pool().release_unused()

    return call
