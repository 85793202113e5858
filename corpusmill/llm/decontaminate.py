"""Benchmark decontamination: an FM-index per shard of training text, searched for every window of every item.

A shard is a few megabytes of a task's documents. All its words are symbols of its index, whatever the benchmark; the
phrases come from files in the shared folder, one bounded block after the other, so a shard is indexed once however
large the benchmark is, and neither the driver nor a task holds more than a block of it.
"""

from __future__ import annotations

import pickle
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import checkpointed, pieces_of, shared_dir, utf8_values
from corpusmill.llm.fmindex import FmIndex

#: A-Z to a-z; digits, a-z and every byte of a non-ASCII character stay; the rest is a break.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Text of the items in one block of phrases.
BLOCK_BYTES = 4 << 20
#: Text that a task takes at once, and words of an index; a longer text is indexed in stretches.
SHARD_BYTES, SHARD_WORDS = 2 << 20, 1 << 19
#: Occurrences located at once within a task.
ROWS_AT_ONCE = 1 << 18


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


@dataclass
class Phrases:
    """Distinct windows of a block of items as rows of symbols, and the items (by place in ``items``) each belongs to."""

    symbols: dict[bytes, int]
    patterns: np.ndarray
    lengths: np.ndarray
    owners: list[tuple[int, ...]]
    items: list


def phrases(rows: list[tuple[object, str | None]], window: int) -> Phrases:
    symbols: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], dict[int, None]] = {}
    ids = list(dict.fromkeys(i for i, _ in rows))
    place = {i: k for k, i in enumerate(ids)}
    for item, text in rows:
        line = [symbols.setdefault(w, len(symbols) + 1) for w in words_of((text or "").encode())]
        for k in range(max(1, len(line) - window + 1) if line else 0):
            owners.setdefault(tuple(line[k : k + window]), {})[place[item]] = None
    keys = list(owners)
    patterns = np.zeros((len(keys), window), np.int32)
    lengths = np.array([len(k) for k in keys], np.int64)
    for row, key in enumerate(keys):
        patterns[row, : len(key)] = key
    return Phrases(symbols, patterns, lengths, [tuple(owners[k]) for k in keys], ids)


def phrase_files(benchmark: DataFrame, window: int, item_col: str, text_col: str, block_bytes: int) -> list[str]:
    """Write the items' phrases in blocks to the shared folder; returns the files, one for each block of text."""
    where = posixpath.join(shared_dir(benchmark.sparkSession), f"phrases-{uuid.uuid4().hex}")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(where)
        fs.create_dir(root, recursive=True)
        held: list[tuple] = []
        size = 0

        def file() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.pickle"
            with fs.open_output_stream(posixpath.join(root, name), compression=None) as f:
                pickle.dump(phrases(held, window), f, protocol=5)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([posixpath.join(where, name)])], names=["name"])

        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), utf8_values(batch.column("text")), strict=True):
                for part in stretches_of(text, window, block_bytes):
                    if held and size + len(part) > block_bytes:
                        yield file()
                        size = 0
                    held.append((item, part.decode("utf-8", "replace")))
                    size += len(part)
        if held:
            yield file()

    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    # Files of other attempts of a task are not in the table and are not read.
    dealt = items.coalesce(max(1, -(-total // block_bytes)))
    return sorted(r["name"] for r in checkpointed(dealt.mapInArrow(put, "name string")).collect())


def stretches_of(text: bytes, window: int, most: int) -> Iterator[bytes]:
    """The text, or if it is longer than ``most`` stretches of it of which each window of words is in one."""
    if len(text) <= most:
        yield text
        return
    words = words_of(text)
    step = max(1, most // 8)
    for at in range(0, max(1, len(words) - window + 1), step):
        yield b" ".join(words[at : at + step + window - 1])


_last: list = [None, None]


def block_of(name: str) -> Phrases:
    """A block of phrases; the last one read stays with the worker."""
    if _last[0] != name:
        fs, path = pafs.FileSystem.from_uri(name)
        with fs.open_input_stream(path, compression=None) as f:
            _last[:] = [name, pickle.loads(f.read())]  # noqa: S301 - written by phrase_files()
    return _last[1]


class Shard:
    """The index of some texts, given as (document, place of the first word, words)."""

    def __init__(self, parts: list[tuple[int, int, list[bytes]]]):
        sizes = np.array([len(w) + 1 for _, _, w in parts], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.document, self.offset = (np.array([p[k] for p in parts], np.int64) for k in (0, 1))
        self.symbols: dict[bytes, int] = {}
        line = np.zeros(int(sizes.sum()), np.int32)
        number = self.symbols.setdefault
        for at, (_, _, words) in zip(self.starts.tolist(), parts, strict=True):
            line[at : at + len(words)] = [number(w, len(self.symbols) + 1) for w in words]
        self.index = FmIndex(line, len(self.symbols))

    def occurrences(self, asked: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, pattern) wherever a pattern stands."""
        own = np.array([0, *(self.symbols.get(w, 0) for w in asked.symbols)], np.int32)[asked.patterns]
        used = np.arange(asked.patterns.shape[1]) < asked.lengths[:, None]
        possible = np.flatnonzero(((own != 0) | ~used).all(axis=1))  # a word that the shard lacks stands nowhere
        lo, hi = self.index.ranges(own[possible], asked.lengths[possible])
        found = np.flatnonzero(hi > lo)
        n = (hi - lo)[found]
        rows = np.repeat(lo[found] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        spots = [self.index.locate(rows[k : k + ROWS_AT_ONCE]) for k in range(0, len(rows), ROWS_AT_ONCE)]
        place = np.concatenate([np.empty(0, np.int64), *spots])
        part = np.searchsorted(self.starts, place, side="right") - 1
        return self.document[part], place - self.starts[part] + self.offset[part], np.repeat(possible[found], n)


def shards_of(lines: list[list[bytes]], window: int) -> Iterator[Shard]:
    """Indexes over all texts; a text of more than SHARD_WORDS words is in several, each window in one at least."""
    held: list[tuple[int, int, list[bytes]]] = []
    size = 0
    for k, words in enumerate(lines):
        for at in range(0, max(0, len(words) - window) + 1 if words else 0, SHARD_WORDS):
            part = words[at : at + SHARD_WORDS + window - 1] if len(words) > SHARD_WORDS else words
            if held and size + len(part) > SHARD_WORDS:
                yield Shard(held)
                held, size = [], 0
            held.append((k, at, part))
            size += len(part)
            if len(words) <= SHARD_WORDS:
                break
    if held:
        yield Shard(held)


def searched(texts: list[bytes], files: list[str], window: int) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """Of each text the number of words, merged spans of words in an occurrence, and ids of the items found, sorted.

    Equal texts are indexed once.
    """
    place: dict[bytes, int] = {}
    which = [place.setdefault(t, len(place)) for t in texts]
    lines = [words_of(t) for t in place]
    begins: list[list[np.ndarray]] = [[] for _ in lines]
    items: list[set] = [set() for _ in lines]
    for shard in shards_of(lines, window) if files else ():
        for name in files:
            asked = block_of(name)
            doc, begin, pattern = shard.occurrences(asked)
            order = np.argsort(doc, kind="stable")
            doc, begin, pattern = doc[order], begin[order], pattern[order]
            cuts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, np.int64)
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(doc)], strict=False):
                begins[doc[a]].append(np.stack([begin[a:b], begin[a:b] + asked.lengths[pattern[a:b]]]))
                items[doc[a]].update(asked.items[i] for p in np.unique(pattern[a:b]).tolist() for i in asked.owners[p])
    spans = [merged(*np.concatenate(x, axis=1)) if x else [] for x in begins]
    named = [sorted(x - {None}) for x in items]
    return [len(lines[k]) for k in which], [spans[k] for k in which], [named[k] for k in which]


def merged(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping and touching spans made one."""
    if not len(begin):
        return []
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    fresh = np.flatnonzero(np.r_[True, begin[1:] > reach[:-1]])
    return list(zip(begin[fresh].tolist(), reach[np.r_[fresh[1:] - 1, len(begin) - 1]].tolist(), strict=True))


SPANS = "doc_id long, n_words long, spans array<struct<begin:int,end:int>>, items array<string>"


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (doc_id, n_words, spans, items), one for each input row.

    spans: merged removal spans of words (begin, end excluded) lying in an occurrence of a window of ``window``
    consecutive words of an item; an item of fewer words, but not none, is one window. items: the ids, as
    strings and sorted, of items with an occurring window; an item whose id is null gives hits but no id.
    Words: runs of a-z, 0-9 and non-ASCII characters after lower-casing A-Z. Null and empty texts have no words
    and no hits; repeated rows are kept; equal windows of several items count for each; other columns are
    ignored; empty tables give no rows or no hits. The benchmark is taken in blocks of at most ``block_bytes``
    of text; a longer item is cut into stretches that share window - 1 words. Nothing of the documents is shuffled.
    """
    files = phrase_files(benchmark, window, item_col, item_text_col, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces_of(batches, "text", SHARD_BYTES):
            counts, spans, items = searched(utf8_values(piece.column("text")), files, window)
            yield pa.RecordBatch.from_arrays([
                piece.column("doc_id"), pa.array(counts, pa.int64()),
                pa.array([[{"begin": a, "end": b} for a, b in own] for own in spans], pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.string())),
            ], names=["doc_id", "n_words", "spans", "items"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SPANS)


def report(found: DataFrame) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of what hits() returns."""
    return found.select(
        "doc_id", "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["begin"])).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def remove_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans: from the first to the last word of each, and the breaks between them."""
    data = text.encode()
    folded = np.frombuffer(data.translate(FOLD), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.r_[False, folded, False].astype(np.int8)))
    begin, end = edges[::2], edges[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : begin[a]])
        at = int(end[b - 1])
    return b"".join([*out, data[at:]]).decode()


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with all their columns, the words of removal spans cut out of ``text_col`` as hits() finds them.

    Documents without a hit keep their text as it is, null and empty included; repeated rows stay repeated; an empty
    table gives an empty result and an empty benchmark leaves all texts alone. No column of another name is used.
    """
    files = phrase_files(benchmark, window, item_col, item_text_col, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces_of(batches, text_col, SHARD_BYTES):
            texts = piece.column(text_col).to_pylist()
            _, spans, _ = searched([(x or "").encode() for x in texts], files, window)
            at = piece.schema.get_field_index(text_col)
            cut = [remove_words(t, own) if own else t for t, own in zip(texts, spans, strict=True)]
            yield piece.set_column(at, piece.schema.field(at), pa.array(cut, piece.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
