"""Exact removal of long repeated byte strings with a logarithmic family of sparse suffix arrays.

A byte is removed if some string of ``length`` bytes over it also starts earlier. Only content-sampled suffixes are
indexed: of the ANCHOR-byte strings in each window of ``length`` bytes the one with the least hash is the window's
anchor, so equal windows have equal anchors at equal offsets. Consecutive windows with one anchor form a piece.

* Round 1 orders anchored suffixes by fingerprints: of the anchor's bytes, then of the whole piece. A piece equal
  to an earlier piece is a repeat as a whole. Pieces with a common anchor but different surroundings go on.
* Round 2 orders the remaining windows by their bytes (a suffix array of the pieces, to depth ``length``) and
  finds those that start earlier too. It compares the bytes themselves.

Both rounds keep an index family: a new batch gets its sorted array, is merge-scanned against every level, then
joins them; levels of similar size are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import checkpointed, grouped_blobs, mix64, pieces_of, release, text_volume, unpack_blobs, utf8_values

ANCHOR = 40
#: Text in one numpy working set; anchors gathered before they are dealt out; rows of a batch of the index family.
SHARD_BYTES, ANCHORS_AT_ONCE, BATCH_ROWS = 1 << 20, 1 << 17, 1 << 16
#: Text whose anchors share a bucket, text of a group of documents, on average.
BUCKET_BYTES, GROUP_BYTES = 12 << 20, 6 << 20
NULL_ID = np.iinfo(np.int64).min

WORDS = mix64(np.arange(1, 64, dtype=np.uint64)) | np.uint64(1)  # odd multipliers
PLACE = [np.int64, np.int64, np.int32]  # document, its text's hash, position
ANCHORED = [np.uint64, np.uint64, *PLACE, np.uint8, np.uint8]  # anchor hash, piece hash, place, largest and least offset
SPAN = [np.uint8, np.uint64, *PLACE, np.int32]  # 0 repeat or 1 to be compared, anchor hash, document, text hash, begin, end


def block_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all strings of ``width`` bytes (a multiple of 8)."""
    if len(data) < width:
        return np.empty(0, np.uint64)
    words = mix64(np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,)))
    n = len(data) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width // 8):
        out += words[8 * k : 8 * k + n] * WORDS[k]
    return out


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def anchored(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Pieces of a run of texts: anchor hash, piece hash, text's place in the run, first and last window, anchor."""
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none
    raw = block_hashes(data, ANCHOR)
    order = mix64(raw)
    low = np.uint64((1 << 24) - 1)
    assert len(data) <= int(low) + 1, "a working set is too long for its positions"
    least = sliding_least((order & ~low) | np.arange(len(order), dtype=np.uint64), length - ANCHOR + 1)
    anchor = (least & low).astype(np.int64)
    ok = np.zeros(len(data) + 1, np.int64)
    has = sizes >= length
    np.add.at(ok, starts[has], 1)
    np.add.at(ok, starts[has] + sizes[has] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(ok)[: len(anchor)])
    if not len(window):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none, none
    a = anchor[window]
    # A text's last window and the next one's first are apart by length - 1 places that are no windows.
    cut = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (window[1:] != window[:-1] + 1)])
    first, last, at = window[cut], window[np.r_[cut[1:] - 1, len(window) - 1]], a[cut]
    text = np.searchsorted(starts, first, side="right") - 1
    # Blocks from the front and from the back cover a piece of less than 2 * length bytes.
    whole = ((at - first) * 256 + (at - last)).astype(np.uint64) * WORDS[10]
    reach = 2 * length - ANCHOR
    for k in range(-(-reach // (2 * ANCHOR))):
        whole += raw[np.minimum(first + k * ANCHOR, last + length - ANCHOR)] * WORDS[11 + 2 * k]
        whole += raw[np.maximum(last + length - (k + 1) * ANCHOR, first)] * WORDS[12 + 2 * k]
    return order[at], mix64(whole), text, first, last, at


class Levels:
    """Sorted arrays whose keys differ, each with the earliest place of its key; later places are handed back.

    Columns: the key (any sortable type), then document, text hash, position, then further ones. ``same``
    confirms that two rows with equal keys are equal.
    """

    def __init__(self, same=None):
        self.levels: list[list[np.ndarray]] = []
        self.same = same

    def add(self, columns: list[np.ndarray]) -> list[list[np.ndarray]]:
        """Take a batch; returns the rows that have an earlier equal, of the batch or of the levels."""
        order = np.argsort(columns[0], kind="stable")
        batch, lost = self._settle([c[order] for c in columns])
        late = [lost]
        for k, level in enumerate(self.levels):
            drop_level, drop_batch, lost = self._scan(level, batch)
            self.levels[k] = [c[~drop_level] for c in level]
            batch = [c[~drop_batch] for c in batch]
            late.append(lost)
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            b, a = self.levels.pop(), self.levels.pop()
            both = [np.concatenate(x) for x in zip(a, b, strict=True)]
            order = np.argsort(both[0], kind="stable")  # two sorted runs: one merge
            self.levels.append([c[order] for c in both])
        return [x for x in late if len(x[0])]

    def all(self) -> list[np.ndarray] | None:
        return [np.concatenate(x) for x in zip(*self.levels, strict=True)] if self.levels else None

    def _settle(self, rows: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Within rows sorted by key: the earliest of each key, and the others."""
        key = rows[0]
        group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1 if len(key) else np.empty(0, np.int64)
        order = np.lexsort((rows[3], rows[2], rows[1], group))
        rows, group = [c[order] for c in rows], group[order]
        first = np.r_[True, group[1:] != group[:-1]] if len(group) else np.empty(0, bool)
        head = np.flatnonzero(first)[group] if len(group) else group
        other = ~first
        if self.same is not None and other.any():
            odd = other & ~self.same(rows, np.arange(len(group)), rows, head)
            if odd.any():
                raise ValueError("two different strings share all fingerprints")
        repeated_row = other & np.logical_and.reduce([c[head] == c for c in rows[1:4]])
        return [c[first] for c in rows], [c[other & ~repeated_row] for c in rows]

    def _scan(self, level: list[np.ndarray], batch: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        n = len(level[0])
        key = np.concatenate([level[0], batch[0]])
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.flatnonzero(key[1:] == key[:-1])
        i, j = order[at], order[at + 1] - n  # stable: the level's row comes first
        if self.same is not None and len(at) and not self.same(level, i, batch, j).all():
            raise ValueError("two different strings share all fingerprints")
        sooner = np.zeros(len(at), bool)  # the batch's row is the earlier one
        equal = np.ones(len(at), bool)
        for a, b in zip(level[1:4], batch[1:4], strict=True):
            sooner |= equal & (b[j] < a[i])
            equal &= b[j] == a[i]
        drop_level, drop_batch = np.zeros(n, bool), np.zeros(len(batch[0]), bool)
        drop_level[i[sooner]] = True
        drop_batch[j[~sooner]] = True
        late = ~sooner & ~equal
        return drop_level, drop_batch, [np.concatenate([a[i[sooner]], b[j[late]]]) for a, b in zip(level, batch, strict=True)]


def _blob_batch(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], names=["bucket", "blob"])


def _of_document(document: np.ndarray, text_hash: np.ndarray, groups: int) -> np.ndarray:
    return (text_hash ^ document ^ (document << 17) ^ (document << 34)) % groups


def _spans(kind: int, key: np.ndarray, rows: list[np.ndarray], begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    return [np.full(len(key), kind, np.uint8), key.astype(np.uint64), rows[0], rows[1], begin.astype(np.int32), end.astype(np.int32)]


def _joined(parts: list[list[np.ndarray]], dtypes: list) -> list[np.ndarray]:
    return [np.concatenate([p[k] for p in parts]) if parts else np.empty(0, t) for k, t in enumerate(dtypes)]


def _same_fingerprints(x, i, y, j):
    return (x[4][i] == y[4][j]) & (x[5][i] == y[5][j])


def _deal_anchors(rows: DataFrame, length: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for piece in pieces_of(batches, "text", SHARD_BYTES):
            texts = utf8_values(piece.column("text"))
            ids = [np.asarray(piece.column(c).to_numpy(zero_copy_only=False), np.int64) for c in ("did", "th")]
            for cols in _cut_long(texts, ids, length):
                held.append(cols)
            if sum(len(h[0]) for h in held) >= ANCHORS_AT_ONCE:
                yield from dealt(held)
                held = []
        yield from dealt(held)

    def dealt(held):
        if held:
            cols = _joined(held, ANCHORED)
            yield _blob_batch(list(grouped_blobs((cols[0] % np.uint64(buckets)).astype(np.int64), cols)))

    return rows.mapInArrow(run, "bucket long, blob binary")


def _cut_long(texts: list[bytes], ids: list[np.ndarray], length: int) -> Iterator[list[np.ndarray]]:
    """Anchored pieces of the texts; one longer than a working set is taken in stretches that overlap in
    length - 1 bytes, so that each window is in one of them. An anchor only depends on its window."""
    stretch = SHARD_BYTES
    jobs = [(k, at, text[at : at + stretch]) for k, text in enumerate(texts) for at in range(0, max(1, len(text) - length + 1), stretch - length + 1)]
    while jobs:
        take, total = [], 0
        while jobs and (not take or total + len(jobs[0][2]) <= stretch):
            take.append(jobs.pop(0))
            total += len(take[-1][2])
        sizes = np.array([len(x) for _, _, x in take], np.int64)
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(x for _, _, x in take), np.uint8)
        key, whole, text, first, last, at = anchored(data, starts, sizes, length)
        doc = np.array([k for k, _, _ in take])[text] if len(text) else text
        base = (np.array([b for _, b, _ in take]) - starts)[text] if len(text) else text
        yield [key, whole, ids[0][doc], ids[1][doc], (at + base).astype(np.int32), (at - first).astype(np.uint8), (at - last).astype(np.uint8)]


def _round_one(key, group, length: int, groups: int):
    release()
    anchor, whole, *rest = unpack_blobs(group.column("blob").to_pylist(), ANCHORED)
    ident = mix64(anchor) + whole * WORDS[40]
    index, out = Levels(_same_fingerprints), []
    columns = [ident, rest[0], rest[1], rest[2], anchor, whole, rest[3], rest[4]]
    for at in range(0, len(ident), BATCH_ROWS):
        out += [_spans(0, x[4], x[1:3], x[3] - x[6].astype(np.int32), x[3] - x[7].astype(np.int32) + length) for x in index.add([c[at : at + BATCH_ROWS] for c in columns])]
    firsts = index.all()
    if firsts is not None:
        order = np.argsort(firsts[4], kind="stable")
        k = firsts[4][order]
        same = k[1:] == k[:-1]
        x = [c[order[np.r_[same, False] | np.r_[False, same]]] for c in firsts]
        out.append(_spans(1, x[4], x[1:3], x[3] - x[6].astype(np.int32), x[3] - x[7].astype(np.int32) + length))
    cols = _joined(out, SPAN)
    return _blob_batch(list(grouped_blobs(_of_document(cols[2], cols[3], groups), cols)))


def _spans_of(group, blobs) -> tuple[list[np.ndarray], np.ndarray, list[bytes]]:
    """Spans of a group of documents, the row each belongs to, and the texts. Repeated rows share their spans."""
    release()
    cols = unpack_blobs(blobs.column("blob").to_pylist(), SPAN)
    texts = utf8_values(group.column("text").combine_chunks() if group.num_rows else pa.array([], pa.string()))
    return cols, np.array(list(zip(*(group.column(c).to_pylist() for c in ("did", "th")), strict=True)), np.int64).reshape(-1, 2), texts


def _deal_pieces(key, group, blobs, buckets: int):
    """The bytes of the pieces to be compared, by anchor: place, number of bytes, then the bytes."""
    (kind, anchor, did, th, begin, end), ids, texts = _spans_of(group, blobs)
    place = {tuple(x): k for k, x in enumerate(ids.tolist())}
    ask = kind == 1
    out: dict[int, list[bytes]] = {}
    for a, d, t, b, e in zip(*(x[ask].tolist() for x in (anchor, did, th, begin, end)), strict=True):
        head = np.array([d, t, b, e - b], np.int64).tobytes()
        out.setdefault(int(a % buckets), []).append(head + texts[place[d, t]][b:e])
    return _blob_batch([(k, b"".join(x)) for k, x in out.items()])


def _round_two(key, group, length: int, groups: int):
    release()
    index, out = Levels(), []
    parts: list[list[np.ndarray]] = []
    held = 0

    def flush():
        cols = _joined(parts, [f"V{length}", np.int64, np.int64, np.int64])
        for x in index.add(cols):
            order = np.lexsort((x[3], x[2], x[1]))
            d, t, p = x[1][order], x[2][order], x[3][order]
            new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (p[1:] != p[:-1] + 1)])
            stop = np.r_[new[1:] - 1, len(p) - 1]
            out.append(_spans(0, np.zeros(len(new), np.uint64), [d[new], t[new]], p[new], p[stop] + length))

    for blob in group.column("blob").to_pylist():
        at = 0
        while at < len(blob):
            d, t, b, n = np.frombuffer(blob, np.int64, 4, at).tolist()
            data = np.frombuffer(blob, np.uint8, n, at + 32)
            windows = np.lib.stride_tricks.sliding_window_view(data, length)
            m = len(windows)
            parts.append([np.ascontiguousarray(windows).view(f"V{length}").ravel(), np.full(m, d), np.full(m, t), np.arange(b, b + m)])
            held += m
            at += 32 + n
            if held >= BATCH_ROWS:
                flush()
                parts.clear()
                held = 0
    if parts:
        flush()
    cols = _joined(out, SPAN)
    return _blob_batch(list(grouped_blobs(_of_document(cols[2], cols[3], groups), cols)))


def _covered(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    fresh = np.flatnonzero(np.r_[True, begin[1:] > reach[:-1]]) if len(begin) else np.empty(0, np.int64)
    return list(zip(begin[fresh].tolist(), reach[np.r_[fresh[1:] - 1, len(begin) - 1]].tolist(), strict=True)) if len(begin) else []


def _finish(key, group, blobs, columns: list[str], text_col: str | None):
    (kind, _, did, th, begin, end), ids, texts = _spans_of(group, blobs)
    repeat = kind == 0
    order = np.flatnonzero(repeat)[np.lexsort((th[repeat], did[repeat]))]
    d, t, begin, end = did[order], th[order], begin[order], end[order]
    cut = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])]) if len(d) else np.empty(0, np.int64)
    own = {(int(d[a]), int(t[a])): (a, b) for a, b in zip(cut.tolist(), np.r_[cut[1:], len(d)][: len(cut)].tolist(), strict=True)}
    spans, kept = [], []
    for doc, text in zip(map(tuple, ids.tolist()), texts, strict=True):
        a, b = own.get(doc, (0, 0))
        gone = _covered(begin[a:b], end[a:b])
        edges = [0, *(x for s in gone for x in s), len(text)]
        if text_col:
            gone = _whole_characters(text, gone)
            edges = [0, *(x for s in gone for x in s), len(text)]
        spans.append([{"begin": x, "end": y} for x, y in gone])
        kept.append(b"".join(text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)))
    data = {c: group.column(f"other_{k}") for k, c in enumerate(columns)}
    if text_col:
        return pa.table(data | {text_col: pa.array([x.decode() for x in kept], pa.string())})
    return pa.table(data | {"repeat_spans": pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), "kept_bytes": pa.array(kept, pa.binary())})


def _whole_characters(text: bytes, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without characters of which they hold only a part."""
    out = []
    for a, b in gone:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b < len(text) and b > a and text[b] & 0xC0 == 0x80:
            b -= 1
        out.append((a, b))
    return out


def deduplicated(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, repeated strings cut out of ``text_col`` as without_repeats() says;
    a character of which only a part would go stays. Null text becomes empty."""
    return without_repeats(docs, length, id_col, text_col, as_text=True)


def without_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """The rows and columns of ``docs`` but for the text, with ``repeat_spans`` (maximal removed runs of bytes,
    end excluded) and ``kept_bytes`` (the remaining bytes).

    A byte goes if a string of ``length`` bytes over it also starts earlier: in a smaller ``id_col``, or earlier in
    the same text; overlaps count; strings never cross texts and are judged on the input. Null and empty texts
    have no bytes. A null id comes before all others. Rows with one id but different texts are ordered by a hash
    of the text; rows alike in id and text count as one document and get equal results. Further columns are
    handed through, whatever their names but ``repeat_spans``, ``kept_bytes``. An empty table gives an empty result.
    """
    if length < 2 * ANCHOR or length > 255:
        raise ValueError(f"length must be {2 * ANCHOR} to 255")
    volume = text_volume(docs, text_col)
    buckets, groups = max(8, -(-volume // BUCKET_BYTES)), max(8, -(-volume // GROUP_BYTES))
    others = [c for c in docs.columns if c != text_col]
    text = F.col(text_col).cast("string")
    did, th = F.coalesce(F.col(id_col).cast("long"), F.lit(int(NULL_ID))), F.xxhash64(text)
    rows = docs.select(did.alias("did"), th.alias("th"), text.alias("text"))

    anchors = _deal_anchors(rows, length, buckets)
    blobs = "bucket long, blob binary"
    one = checkpointed(anchors.groupBy("bucket").applyInArrow(lambda k, g: pa.Table.from_batches([_round_one(k, g, length, groups)]), blobs))

    # The same exchange of the texts serves both cogroups.
    dealt = docs.select(_group_of(did, th, groups).alias("bucket_of"), did.alias("did"), th.alias("th"), text.alias("text"), *[F.col(f"`{c}`").alias(f"other_{k}") for k, c in enumerate(others)])
    by_group = dealt.groupBy("bucket_of")
    pieces = by_group.cogroup(one.groupBy("bucket")).applyInArrow(lambda k, g, b: pa.Table.from_batches([_deal_pieces(k, g, b, buckets)]), blobs)
    two = pieces.groupBy("bucket").applyInArrow(lambda k, g: pa.Table.from_batches([_round_two(k, g, length, groups)]), blobs)
    result = [f"`{text_col}` string"] if as_text else ["repeat_spans array<struct<begin:int,end:int>>", "kept_bytes binary"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col), *result])
    done = by_group.cogroup(one.unionByName(two).groupBy("bucket")).applyInArrow(lambda k, g, b: _finish(k, g, b, others, text_col if as_text else None), schema)
    return done.select(*docs.columns) if as_text else done


def _group_of(did, th, groups: int):
    """The group of a document, as _of_document deals it."""
    spread = did.bitwiseXOR(F.shiftleft(did, 17)).bitwiseXOR(F.shiftleft(did, 34))
    return F.pmod(th.bitwiseXOR(spread), F.lit(groups).cast("long"))


def digests(result: DataFrame) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256) of what without_repeats() returns."""
    removed = F.aggregate("repeat_spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["begin"]))
    return result.select("doc_id", (removed + F.length("kept_bytes")).alias("n_bytes"), removed.alias("n_removed"), F.size("repeat_spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))
