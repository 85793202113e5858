"""SimHash near-duplicate linking through a generalised pigeonhole index.

Bits of the fingerprint are grouped by correlation into partitions; a dynamic program gives each partition a
threshold of its own (-1: not probed) from estimated candidate counts. By the generalised pigeonhole principle
thresholds t_i with sum(t_i + 1) = tau + 1 let two fingerprints within tau bits agree within t_i bits in one
partition at least, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import grouped_blobs, mix64, pieces_of, unpack_blobs, utf8_values
from corpusmill.llm.components import connected_components

WORD_BREAKS = b"\x09\x0a\x0b\x0c\x0d\x20"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEED = 42
#: Relative costs of shuffling one signature and of verifying one candidate, for the dynamic program.
SIGNATURE_COST, CANDIDATE_COST = 1.0, 0.02
#: Candidate pairs expanded at once within a task.
PAIRS_AT_ONCE = 1 << 21
#: Signatures meant for one bucket.
BUCKET_ROWS = 1 << 18


def fingerprint(text: bytes, shingle_words: int) -> int:
    """Majority vote over the bits of the hashes of all word shingles, repeats included."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    digests = _shingle_digests(words, shingle_words)
    bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8), axis=1)
    votes = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(digests)).tobytes(), "big")


def _shingle_digests(words: list[bytes], n: int) -> list[bytes]:
    digest = xxhash.xxh64_digest
    line = b" ".join(words)
    if len(words) <= n:
        return [digest(line, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]][: len(words) - n + 1].tolist()
    return [digest(line[a:b], SEED) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=True)]


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle_words: int) -> DataFrame:
    """Rows (doc_id, fp long): one for each input row; null or wordless text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces_of(batches, "text"):
            fps = [fingerprint(x, shingle_words) for x in utf8_values(piece.column("text"))]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- planning: which bits go together, which thresholds


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64), np.int64), 0
        for batch in batches:
            fp = np.asarray(batch.column("fp").to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
            for at in range(0, len(fp), 1 << 16):
                part = fp[at : at + (1 << 16)]
                bits = ((part[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
                total += (bits.T @ bits).astype(np.int64)
            n += len(fp)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.arange(4096), 4096]), pa.array(np.r_[total.ravel(), n])], names=["cell", "n"])

    sums = {r["cell"]: r["n"] for r in distinct.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    return int(sums.get(4096, 0)), np.array([sums.get(i, 0) for i in range(4096)], float).reshape(64, 64)


def correlated_groups(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt into groups of nearly equal width, each grown by the strongest absolute correlation."""
    p = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    strength = np.abs(cov / np.outer(sd, sd))
    left, groups = set(range(64)), []
    for k in range(parts):
        width = (64 - sum(map(len, groups))) // (parts - k)
        first = min(left, key=lambda b: (-strength[b, sorted(left - {b})].sum() if len(left) > 1 else 0, b))
        group = [first]
        left.discard(first)
        while len(group) < width:
            best = min(left, key=lambda b: (-strength[b, group].sum(), b))
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def estimated_candidates(n: int, together: np.ndarray, group: list[int], most: int) -> list[float]:
    """Expected pairs within 0..most bits of each other in the group, bits taken as independent of each other."""
    p = np.diag(together)[group] / max(n, 1)
    spread = np.zeros(most + 1)
    spread[0] = 1.0
    for q in 2 * p * (1 - p):
        spread = spread * (1 - q) + np.r_[0.0, spread[:-1]] * q
    return (np.cumsum(spread) * n * n / 2).tolist()


def allocate(costs: list[list[float]], tau: int) -> tuple[float, list[int]]:
    """Thresholds of least total cost with sum(t + 1) = tau + 1; costs[i][t + 1] is that of threshold t in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for extra in range(min(len(row) - 1, tau + 1 - used) + 1):
                offer = (cost + row[extra], [*chosen, extra - 1])
                if used + extra not in step or offer < step[used + extra]:
                    step[used + extra] = offer
        best = step
    return best.get(tau + 1, (float("inf"), []))


def plan_index(n: int, together: np.ndarray, tau: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each partition that is probed: the cheapest over 1 to tau + 1 partitions."""
    options = []
    for parts in range(1, tau + 2):
        groups = correlated_groups(n, together, parts)
        costs = []
        for g in groups:
            pairs, most = estimated_candidates(n, together, g, min(tau, 3)), min(tau, 3)
            costs.append([0.0] + [SIGNATURE_COST * n * (1 + sum(comb(len(g), k) for k in range(t + 1))) + CANDIDATE_COST * pairs[t] for t in range(most + 1)])
        cost, chosen = allocate(costs, tau)
        options.append((cost, parts, [(g, t) for g, t in zip(groups, chosen, strict=False) if t >= 0]))
    return min(options)[2]


# ---------------------------------------------------------------- probing and verifying


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the components of the given edges: every node and the smallest node it reaches."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while not np.array_equal(hop := new[new], new):
            new = hop
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


SIGNATURE = [np.uint8, np.uint8, np.uint64, np.uint64, np.int64]  # partition, flips, value, fingerprint, node


def links(distinct: DataFrame, plan: list[tuple[list[int], int]], tau: int, buckets: int) -> DataFrame:
    """Rows (a, b) of nodes whose components are those of all fingerprint pairs within ``tau`` bits.

    ``distinct`` has (fp, node), fp once. Signatures meet in buckets of the (partition, value) hash; a bucket
    compares in numpy, PAIRS_AT_ONCE pairs at a time, and passes on a star forest, not the pairs.
    """
    masks = [np.uint64(sum(1 << b for b in bits)) for bits, _ in plan]
    flips = [[(len(c), np.uint64(sum(1 << b for b in c))) for k in range(t + 1) for c in combinations(bits, k)] for bits, t in plan]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1 << 14):
                batch = whole.slice(at, 1 << 14)
                fp = np.asarray(batch.column("fp").to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
                node = np.asarray(batch.column("node").to_numpy(zero_copy_only=False), np.int64)
                rows: list[list[np.ndarray]] = [[] for _ in SIGNATURE]
                for i, (mask, tries) in enumerate(zip(masks, flips, strict=True)):
                    for k, flip in tries:
                        for col, x in zip(rows, (np.full(len(fp), i, np.uint8), np.full(len(fp), k, np.uint8), (fp ^ flip) & mask, fp, node), strict=True):
                            col.append(x)
                cols = [np.concatenate(x) for x in rows]
                bucket = (mix64(cols[2] + mix64(cols[0].astype(np.uint64) + np.uint64(1))) % np.uint64(buckets)).astype(np.int64)
                found = list(grouped_blobs(bucket, cols))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["bucket", "blob"])

    def probe(key, group):
        part, flipped, value, fp, node = unpack_blobs(group.column("blob").to_pylist(), SIGNATURE)
        order = np.lexsort((node, flipped, value, part))
        part, flipped, value, fp, node = (x[order] for x in (part, flipped, value, fp, node))
        fresh = np.r_[True, (part[1:] != part[:-1]) | (value[1:] != value[:-1])]
        run = np.cumsum(fresh) - 1
        start = np.flatnonzero(fresh)
        homes = np.bincount(run, weights=flipped == 0, minlength=len(start)).astype(np.int64)
        # Each signature meets the homes of its run; a home meets only the homes after it.
        first = np.where(flipped == 0, np.arange(len(fp)) + 1, start[run])
        n = start[run] + homes[run] - first
        ea, eb = np.empty(0, np.int64), np.empty(0, np.int64)
        ends = np.cumsum(n)
        at, done = 0, 0
        while done < (int(ends[-1]) if len(ends) else 0):
            # A signature with more homes than fit at once is taken in several goes.
            to = min(done + PAIRS_AT_ONCE, int(ends[-1]))
            hi = int(np.searchsorted(ends, to, side="left")) + 1
            rows = np.arange(at, hi)
            lo_of = np.maximum(ends[rows] - n[rows], done)
            hi_of = np.minimum(ends[rows], to)
            m = hi_of - lo_of
            left = np.repeat(rows, m)
            step = np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m)
            right = np.repeat(first[rows] + lo_of - (ends[rows] - n[rows]), m) + step
            near = (np.bitwise_count(fp[left] ^ fp[right]) <= tau) & (node[left] != node[right])
            if near.any():
                ea, eb = _forest(np.r_[ea, node[left[near]]], np.r_[eb, node[right[near]]])
            done, at = to, hi - 1
        return pa.table({"a": pa.array(ea, pa.int64()), "b": pa.array(eb, pa.int64())})

    blobs = distinct.mapInArrow(sign, "bucket long, blob binary")
    return blobs.groupBy("bucket").applyInArrow(probe, "a long, b long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, max_bits: int = 4) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each input row.

    Texts lower-cased in A-Z only; words split at ASCII white space. Null, empty and wordless texts have
    fingerprint zero and are linked like any other. Equal fingerprints are one node, so copies cost one row.
    component_id is the smallest doc_id reachable over links of at most ``max_bits`` differing bits; a row
    whose doc_id is null gets the component of its fingerprint (null if that has no other doc_id). Repeated
    doc_ids stay repeated. An empty table gives an empty result. Other columns are ignored.
    """
    prints = fingerprints(docs, id_col, text_col, shingle_words)
    return linked(prints, max_bits)


def linked(prints: DataFrame, max_bits: int) -> DataFrame:
    from corpusmill.llm.common import checkpointed

    prints = checkpointed(prints)
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("node")))
    keyed = distinct.where("node is not null")
    n, together = bit_statistics(keyed)
    if n == 0:
        return prints.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.lit(None).cast("long").alias("component_id"))
    plan = plan_index(n, together, max_bits)
    per_node = sum(1 + sum(comb(len(bits), k) for k in range(t + 1)) for bits, t in plan)
    buckets = max(8, -(-n * per_node // BUCKET_ROWS))
    # One doc_id can carry several texts: such fingerprints are one node of the graph.
    members = connected_components(links(keyed, plan, max_bits, buckets))
    found = distinct.join(members, distinct["node"] == members["node"], "left").select("fp", F.coalesce("component", distinct["node"]).alias("component_id"))
    return prints.join(found, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, max_bits: int = 4) -> DataFrame:
    """The documents with all their columns, one of each component of simhash_components(): that of the smallest id.

    A row whose id is null stands under a hash of its text. Of rows with one id one stays.
    """
    own = F.coalesce(F.col(id_col).cast("long"), F.shiftrightunsigned(F.xxhash64(F.col(text_col)), 1))
    name = next(f"node_{k}" for k in range(len(docs.columns) + 1) if f"node_{k}" not in docs.columns)
    found = simhash_components(docs.select(own.alias("doc_id"), F.col(text_col).cast("string").alias("text")), shingle_words=shingle_words, max_bits=max_bits)
    stay = found.where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.withColumn(name, own).join(stay, name, "left_semi").dropDuplicates([name]).drop(name)
