"""Near-duplicates by the Jaccard similarity of their sets of word shingles: every pair at or above the threshold.

SimHash fingerprints of the sets are linked first, through the generalised pigeonhole index of simhash.py, and each link
is checked on the whole sets. A fingerprint misses most pairs close to the threshold, so an exact path follows for what
is not linked yet. Two sets of that similarity share a number of shingles among the first of each in any one order of all
shingles (prefix filter, lengthened for large sets so that more than one must be shared), here the least common first. Such
pairs are verified on the whole sets; nothing rests on chance but the 64-bit hashes of shingles and of sets. Pairs that
stand close to each other in the lists of a few least hashes are verified with the first links, so that a group of copies
is one component early; then all pairs of different components.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import checkpointed, grouped_blobs, mix64, pieces_of, release, sweep, unpack_blobs, utf8_values
from corpusmill.llm.components import connected_components
from corpusmill.llm.simhash import BUCKET_ROWS as SIGNATURE_ROWS
from corpusmill.llm.simhash import LOWER, _shingle_digests, bit_statistics, links, plan_index

#: Shingles are counted on one of so many texts; the counts set the order of shingles, never the result.
SAMPLE = 16
#: Shingles put last in the order, at most.
COMMON_SHINGLES = 1 << 17
#: Texts whose hashes are broadcast, at most; more are joined by a shuffle.
BROADCAST_TEXTS = 1 << 22
#: Hashes of whole sets that are broadcast to verify pairs, at most (16 MB); more are joined by a shuffle.
BROADCAST_HASHES = 1 << 21
#: Text that a worker turns into sets at once, and postings meant for one bucket.
PIECE_BYTES, BUCKET_ROWS = 1 << 20, 1 << 18
POSTING = [np.int64, np.int32, np.int32, np.int64, np.int64]  # shingle, its place in the order of the set, size of the set, node, component so far
#: Pairs expanded at once within a task.
PAIRS_AT_ONCE = 1 << 18
#: Least hashes for the first links; the sets that follow one in a list and meet it; hashes that such a pair must share.
LEAST_HASHES, NEXT_SETS, LEAST_SHARED = 8, 4, 6


def shingle_set(text: bytes, shingle_words: int) -> np.ndarray:
    """Sorted distinct hashes of all word shingles; a text of fewer words is one shingle, one without words has none."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.int64)
    return np.unique(np.frombuffer(b"".join(_shingle_digests(words, shingle_words)), np.int64))


def must_share(n):
    """How many shingles the prefixes of two sets share at least, for the smaller one's size."""
    return 1 + n // 64


def node_of(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def fingerprint(found: np.ndarray) -> int:
    """Majority vote over the bits of the hashes of a set, as a signed number."""
    bits = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1)
    return int(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(found)).view(np.int64)[0])


def common_shingles(docs: DataFrame, shingle_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the shingles most common in a sample of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces_of(batches, "text", PIECE_BYTES):
            found = [shingle_set(x, shingle_words) for x in utf8_values(piece.column("text"))]
            h, n = np.unique(np.concatenate([np.empty(0, np.int64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    sample = docs.where(F.pmod("key", F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "h long, n long")
    rows = sample.groupBy("h").agg(F.sum("n").alias("n")).where("n >= 3").orderBy(F.desc("n"), "h").limit(COMMON_SHINGLES).collect()
    h, n = (np.array([r[k] for r in rows], np.int64) for k in ("h", "n"))
    order = np.argsort(h)
    return h[order], n[order]


def prefixes(docs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Rows (nameless, id, key, node, n, prefix, least, fp), one for each input row; repeats within a piece have a null prefix."""
    common, times = common_shingles(docs, shingle_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces_of(batches, "text", PIECE_BYTES):
            nodes, sizes, firsts, least, prints, seen = [], [], [], [], [], set()
            for x in utf8_values(piece.column("text")):
                found = shingle_set(x, shingle_words)
                node, n = node_of(found), len(found)
                nodes.append(node)
                sizes.append(n)
                if node in seen or not n:
                    firsts.append(None)
                    least.append(None)
                    prints.append(None)
                    continue
                seen.add(node)
                rank = np.zeros(n, np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
                    rank = np.where(common[at] == found, times[at], 0)
                firsts.append(found[np.lexsort((found, rank))][: n - -(-percent * n // 100) + must_share(n)])
                least.append(found[np.argsort(mix64(found.view(np.uint64)))[:LEAST_HASHES]])
                prints.append(fingerprint(found))
            yield pa.RecordBatch.from_arrays(
                [piece.column(c) for c in ("nameless", "id", "key")] + [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64())), pa.array(least, pa.list_(pa.int64())), pa.array(prints, pa.int64())],
                names=["nameless", "id", "key", "node", "n", "prefix", "least", "fp"],
            )

    return docs.mapInArrow(run, "nameless boolean, id long, key long, node long, n int, prefix array<long>, least array<long>, fp long")


def close_fingerprints(sets: DataFrame, max_bits: int) -> DataFrame:
    """Rows (a, b) of nodes whose components are those of all pairs of fingerprints within ``max_bits`` bits.

    ``sets`` has (node, fp). The index is that of simhash.links(): bits grouped by correlation, thresholds by dynamic
    programming, signatures probed and verified. Sets of one fingerprint are linked to the first of them.
    """
    sets = checkpointed(sets.select("node", "fp").distinct())
    distinct = checkpointed(sets.groupBy("fp").agg(F.min("node").alias("node")))
    alike = sets.join(distinct.withColumnsRenamed({"node": "first"}), "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    n, together = bit_statistics(distinct)
    if not n:
        return alike
    plan = plan_index(n, together, max_bits)
    per_node = sum(1 + sum(comb(len(bits), k) for k in range(t + 1)) for bits, t in plan)
    found = links(distinct, plan, max_bits, max(8, -(-n * per_node // SIGNATURE_ROWS)))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(alike)


def candidates(known: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b) of all pairs of nodes of different components ``c`` that share as many prefix shingles as they must."""
    total = known.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(8, -(-total // BUCKET_ROWS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1 << 10):
                batch = whole.slice(at, 1 << 10)
                prefix = batch.column("prefix")
                times = np.asarray(prefix.value_lengths())
                h = np.asarray(prefix.flatten(), np.int64)
                place = np.arange(len(h)) - np.repeat(np.cumsum(times) - times, times)
                n, node, c = (np.repeat(np.asarray(batch.column(x)), times) for x in ("n", "node", "c"))
                found = list(grouped_blobs((mix64(h.view(np.uint64)) % np.uint64(buckets)).astype(np.int64), [h, place.astype(np.int32), n.astype(np.int32), node, c]))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["bucket", "blob"])

    def meet(key, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, place, n, node, c = unpack_blobs([x for batch in group for x in batch.column("blob").to_pylist()], POSTING)
        order = np.lexsort((node, c, h))
        h, place, n, node, c = (x[order] for x in (h, place, n, node, c))
        once = np.r_[True, (h[1:] != h[:-1]) | (node[1:] != node[:-1])][: len(h)]
        h, place, n, node, c = (x[once] for x in (h, place, n, node, c))
        if not len(h):
            return
        # A posting meets those of the components after its own in its list: none within a component is expanded.
        list_end = np.r_[np.flatnonzero(h[1:] != h[:-1]) + 1, len(h)]
        own_end = np.r_[np.flatnonzero((h[1:] != h[:-1]) | (c[1:] != c[:-1])) + 1, len(h)]
        at = np.arange(len(h))
        first = own_end[np.searchsorted(own_end, at, side="right")]
        most = list_end[np.searchsorted(list_end, at, side="right")] - first
        ends = np.cumsum(most)
        for done in range(0, int(ends[-1]), PAIRS_AT_ONCE):
            t = np.arange(done, min(done + PAIRS_AT_ONCE, int(ends[-1])))
            left = np.searchsorted(ends, t, side="right")
            right = first[left] + t - (ends[left] - most[left])
            x, y = n[left].astype(np.int64), n[right].astype(np.int64)
            need = must_share(np.minimum(x, y))
            # Sets of these sizes share ``overlap`` at least, so ``need`` of them before either has less than that left.
            overlap = -(-percent * (x + y) // (100 + percent))
            early = (overlap <= np.minimum(x, y)) & (place[left] < x - overlap + need) & (place[right] < y - overlap + need)
            left, right, need = left[early], right[early], need[early]
            a, b = np.minimum(node[left], node[right]), np.maximum(node[left], node[right])
            order = np.lexsort((b, a))
            a, b, need = a[order], b[order], need[order]
            first_of = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)])
            times = np.diff(np.r_[first_of, len(a)])
            yield pa.RecordBatch.from_arrays([pa.array(a[first_of]), pa.array(b[first_of]), pa.array(need[first_of].astype(np.int64)), pa.array(times.astype(np.int64))], names=["a", "b", "need", "times"])

    blobs = known.select("n", "node", "c", "prefix").mapInArrow(deal, "bucket long, blob binary")
    found = blobs.groupBy("bucket").applyInArrow(by_batches(meet), "a long, b long, need long, times long")
    return found.groupBy("a", "b").agg(F.min("need").alias("need"), F.sum("times").alias("times")).where("times >= need").select("a", "b")


def by_batches(run):
    """``run`` with the annotations by which Spark passes a group as batches."""

    def call(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(key, group)
        release()

    return call


def neighbours(sets: DataFrame) -> DataFrame:
    """Rows (a, b) of sets that stand close in the list of one of their least hashes and share most of these.

    ``sets`` has (node, least). Each list is in an order of its own, so a set meets others in each; lists are cut over
    tasks. As many pairs as postings, times NEXT_SETS, at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, node = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), np.int64) for c in ("h", "node"))
            own = batch.column("least")
            least = np.zeros((len(h), LEAST_HASHES), np.int64)
            times = np.asarray(own.value_lengths())
            rows = np.repeat(np.arange(len(h)), times)
            least[rows, np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)] = np.asarray(own.flatten(), np.int64)
            old = 0 if last is None else len(last[0])
            if last is not None:
                h, node, least, times = (np.concatenate([x, y]) for x, y in zip(last, (h, node, least, times), strict=True))
            found = []
            for step in range(1, NEXT_SETS + 1):
                i = np.arange(max(0, old - step), len(h) - step)
                i = i[(h[i] == h[i + step]) & (node[i] != node[i + step])]
                shared = (least[i][:, :, None] == least[i + step][:, None, :]).any(axis=2)
                shared &= np.arange(LEAST_HASHES) < times[i][:, None]
                near = i[shared.sum(axis=1) >= np.minimum(LEAST_SHARED, np.minimum(times[i], times[i + step]))]
                found.append((np.minimum(node[near], node[near + step]), np.maximum(node[near], node[near + step])))
            last = tuple(x[-NEXT_SETS:] for x in (h, node, least, times))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], names=["a", "b"])

    postings = sets.select("node", "least", F.explode("least").alias("h")).dropDuplicates(["h", "node"]).withColumn("turn", F.xxhash64("h", "node"))
    found = postings.repartitionByRange("h", "turn").sortWithinPartitions("h", "turn").select("h", "node", "least").mapInArrow(run, "a long, b long")
    return found.distinct()


def verified(pairs: DataFrame, rows: DataFrame, known: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Those distinct rows (a, b), of nodes, whose sets are as similar as asked."""
    pairs = checkpointed(pairs)
    sweep(rows.sparkSession)  # what found the pairs
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    # One row of each node before the join: a group of copies is one node, and its rows would all meet there.
    heads = known.groupBy("node").agg(F.min("key").alias("key"))
    wanted = checkpointed(heads.join(asked, "node", "left_semi").select("key"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces_of(batches, "text", PIECE_BYTES):
            found = {node_of(s): s for s in (shingle_set(x, shingle_words) for x in utf8_values(piece.column("text")))}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))], names=["node", "hs"])

    texts = rows.join(small(wanted), "key", "left_semi").select("text")
    sets = checkpointed(texts.mapInArrow(whole, "node long, hs array<long>").dropDuplicates(["node"]))
    sweep(rows.sparkSession)  # the shuffle of whole sets
    # Where the sets are few, pairs do not carry them through a shuffle.
    size = sets.agg(F.coalesce(F.sum(F.size("hs") + 4), F.lit(0)).alias("n")).first()["n"]
    sets = F.broadcast(sets) if size <= BROADCAST_HASHES else sets
    both = pairs.join(sets.withColumnsRenamed({"node": "a", "hs": "ha"}), "a").join(sets.withColumnsRenamed({"node": "b", "hs": "hb"}), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("ha", "hb")).alias("s"), (F.size("ha") + F.size("hb")).alias("n"))
    return checkpointed(shared.where(F.col("s") * 100 >= (F.col("n") - F.col("s")) * percent).select("a", "b"))


def small(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_TEXTS else keys


def near_deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, max_bits: int = 4) -> DataFrame:
    """The documents with all their columns, one of each component: the row of the smallest id.

    Two texts are linked if their sets of shingles have a Jaccard similarity of ``percent`` or more. Fingerprints within
    ``max_bits`` bits are checked first; the radius changes what is found when, not what is found. Texts are
    lower-cased in A-Z only; words split at ASCII white space; texts without words are alike. Rows are told apart
    by id and text, so rows of one id and unlike texts all stay; a null id comes after all others.
    """
    rows = docs.select(
        F.col(id_col).isNull().alias("nameless"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(F.col(text_col).cast("string")).alias("key"), F.col(text_col).cast("string").alias("text"),
    )
    known = checkpointed(prefixes(rows, shingle_words, percent))
    sets = known.where("prefix is not null")
    alike = verified(close_fingerprints(sets, max_bits).unionByName(neighbours(sets)).distinct(), rows, known, shingle_words, percent)
    members = connected_components(alike)
    sweep(docs.sparkSession)
    placed = sets.join(small(members), "node", "left").withColumn("c", F.coalesce("component", "node"))
    alike = alike.unionByName(verified(candidates(placed, percent), rows, known, shingle_words, percent))
    members = connected_components(alike)

    first = F.min(F.struct("nameless", "id", "key")).alias("m")
    own = known.groupBy("node").agg(first).join(members, "node", "left").select(F.coalesce("component", "node").alias("c"), "m.*")
    stay = own.groupBy("c").agg(first).select("m.*")
    names = {c: next(f"{c}_{k}" for k in range(len(docs.columns) + 1) if f"{c}_{k}" not in docs.columns) for c in ("nameless", "id", "key")}
    named = docs.withColumns({
        names["nameless"]: F.col(id_col).isNull(), names["id"]: F.coalesce(F.col(id_col).cast("long"), F.lit(0)), names["key"]: F.xxhash64(F.col(text_col).cast("string")),
    })
    return named.join(stay.withColumnsRenamed(names), list(names.values()), "left_semi").dropDuplicates(list(names.values())).select(*docs.columns)
