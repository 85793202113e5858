"""BPE encoding and decoding of whole texts, long ones in parallel by tree concatenation.

A long text is cut into leaves that are encoded apart. Two neighbours are joined by encoding a window around
the cut again: it starts at a token of the left part and ends at a token of the right part, and grows until its
first token equals the left part's and its last token the right part's. A BPE sequence is the right one exactly
if each two neighbours in it are (what the pair's own text encodes to), so agreement at both ends makes the
spliced sequence the encoding of the whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import pieces_of

#: Texts of more bytes are cut into leaves of about LEAF_BYTES, encoded in parallel.
LONG_BYTES, LEAF_BYTES = 1 << 16, 1 << 15
#: Chunks remembered by a worker; beyond that it starts anew.
REMEMBERED = 250_000
#: Characters for which NFC changes nothing and lower-casing keeps each UTF-8 length; white space is ASCII.
PLAIN = re.compile("[^\t-\r -~¡-¬®-įı-ž]")
FIRST_WINDOW = 4
#: Fixed value: the pieces into which the tokenizers file splits normalised text.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next code point from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


@dataclass
class Tokens:
    """Ids with their byte spans in ``text`` (normalised UTF-8)."""

    text: bytes
    ids: list[int]
    starts: list[int]
    ends: list[int]


class WordBpe:
    """A tokenizers file whose pre-tokenizer never crosses white space and whose normaliser makes it single spaces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, tuple[tuple[int, ...], str]] = {}
        self.pieces: dict[str, tuple[tuple[int, ...], str]] = {}
        self.letters = dict(enumerate(byte_letters()))
        self.spans: dict[str, tuple[tuple[int, ...], tuple[int, ...]]] = {}
        self.names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = added
        self.cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None

    def segments(self, text: str) -> list[str | int]:
        """Normalised stretches between added tokens, which stand as their ids."""
        found = self.cut.split(text) if self.cut and any(x in text for x in self.added) else [text]
        return [self.added[x] if x in self.added else self.normal(x) for x in found if x]

    def normal(self, text: str) -> str:
        if PLAIN.search(text) is None:
            return text.lower()
        return self.tokenizer.normalizer.normalize_str(text)

    @staticmethod
    def chunks(normal: str) -> list[str]:
        return normal.split() if PLAIN.search(normal) is None else [x for x in normal.split(" ") if x]

    def chunk(self, chunk: str) -> tuple[list[int], list[int]]:
        """Ids and byte lengths of the tokens of a chunk without white space."""
        ids: list[int] = []
        lengths: list[int] = []
        for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(chunk):
            tokens = self.tokenizer.model.tokenize(piece)
            ids += [t.id for t in tokens]
            own = [len(t.value) for t in tokens[:-1]]
            lengths += [*own, len(piece) - sum(own)]
        return ids, lengths

    def piece(self, piece: str) -> tuple[tuple[int, ...], str]:
        """Tokens of one piece of the pre-tokenizer, remembered."""
        if len(self.pieces) >= REMEMBERED:
            self.pieces.clear()
        ids = tuple([t.id for t in self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))])
        self.pieces[piece] = found = (ids, " ".join([self.names[i] for i in ids]))
        return found

    def word(self, chunk: str) -> tuple[tuple[int, ...], str]:
        """Tokens of a chunk without white space, remembered."""
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        if PLAIN.search(chunk) is None:
            parts = [self.pieces.get(x) or self.piece(x) for x in PIECE.findall(chunk)]
            found = parts[0] if len(parts) == 1 else (tuple(chain.from_iterable([x for x, _ in parts])), " ".join([x for _, x in parts]))
        else:
            ids = tuple(self.chunk(chunk)[0])
            found = (ids, " ".join([self.names[i] for i in ids]))
        self.words[chunk] = found
        return found

    def encode_decoded(self, text: str) -> tuple[array, str]:
        """Ids of a whole text, and these ids decoded."""
        ids, names, known, word = array("i"), [], self.words, self.word
        for segment in self.segments(text):
            if isinstance(segment, int):
                ids.append(segment)
                names.append(self.names[segment])
                continue
            for chunk in self.chunks(segment):
                own, name = known.get(chunk) or word(chunk)
                if own:
                    ids.extend(own)
                    names.append(name)
        return ids, " ".join(names)

    def decode(self, ids) -> str:
        return " ".join([self.names[i] for i in ids])

    def leaf(self, normal: bytes) -> Tokens:
        """Tokens of a normalised stretch with their byte spans."""
        out = Tokens(normal, [], [], [])
        at = 0
        for chunk in self.chunks(normal.decode()):
            known = self.spans.get(chunk)
            if known is None:
                if len(self.spans) >= REMEMBERED // 4:
                    self.spans.clear()
                known = self.spans[chunk] = tuple(map(tuple, self.chunk(chunk)))
            at = normal.index(chunk.encode(), at)
            for i, n in zip(*known, strict=True):
                out.ids.append(i)
                out.starts.append(at)
                at += n
                out.ends.append(at)
        return out

    def join(self, left: Tokens, right: Tokens) -> Tokens:
        """The tokens of left.text + right.text."""
        n, k = len(left.text), FIRST_WINDOW
        while True:
            i, j = max(0, len(left.ids) - k), min(len(right.ids), k)
            while i > 0 and left.text[left.starts[i]] & 0xC0 == 0x80:
                i -= 1
            while j < len(right.ids) and right.ends[j - 1] < len(right.text) and right.text[right.ends[j - 1]] & 0xC0 == 0x80:
                j += 1
            lo = left.starts[i] if i > 0 else 0
            hi = right.ends[j - 1] if 0 < j < len(right.ids) else len(right.text)
            whole = j >= len(right.ids)
            window = self.leaf(left.text[lo:] + right.text[:hi])
            same_left = i == 0 or bool(window.ids) and (window.ids[0], window.starts[0] + lo, window.ends[0] + lo) == (left.ids[i], left.starts[i], left.ends[i])
            same_right = whole or bool(window.ids) and (window.ids[-1], window.starts[-1] + lo - n, window.ends[-1] + lo - n) == (right.ids[j - 1], right.starts[j - 1], right.ends[j - 1])
            if same_left and same_right:
                break
            k *= 2
        tail = slice(len(right.ids) if whole else j, None)
        return Tokens(
            left.text + right.text,
            left.ids[:i] + window.ids + right.ids[tail],
            left.starts[:i] + [x + lo for x in window.starts] + [x + n for x in right.starts[tail]],
            left.ends[:i] + [x + lo for x in window.ends] + [x + n for x in right.ends[tail]],
        )

    def joined(self, leaves: list[Tokens]) -> Tokens:
        """Neighbours joined pair by pair, level by level."""
        while len(leaves) > 1:
            leaves = [self.join(*leaves[k : k + 2]) if k + 1 < len(leaves) else leaves[k] for k in range(0, len(leaves), 2)]
        return leaves[0]


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


def halves(normal: bytes, most: int) -> list[bytes]:
    """The text cut in half again and again, between characters, until no part is longer than ``most``."""
    if len(normal) <= most:
        return [normal]
    mid = len(normal) // 2
    while normal[mid] & 0xC0 == 0x80:
        mid -= 1
    return halves(normal[:mid], most) + halves(normal[mid:], most) if mid else [normal]


RESULT = "doc_id long, ids array<int>, decoded string"


def _int_lists(rows: list[array]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.frombuffer(b"".join(x.tobytes() for x in rows), np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", long_bytes: int = LONG_BYTES, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """Rows (doc_id, ids, decoded), one for each input row, as the library encodes and decodes whole texts.

    ``tokenizer_path`` names a tokenizers file on every machine. Null and empty texts have no ids and decode to
    the empty string; null and repeated doc_ids are kept as they are; other columns are ignored; an empty table
    gives an empty result. Texts over ``long_bytes`` are the only ones shuffled: their leaves are encoded by
    different tasks, then joined.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer_path)
        for piece in pieces_of(batches, "text", 2 << 20):
            done = [bpe.encode_decoded(x) for x in piece.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), _int_lists([x for x, _ in done]), pa.array([x for _, x in done], pa.string())], names=["doc_id", "ids", "decoded"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer_path)
        for piece in pieces_of(batches, "text", 1):
            for doc_id, key, text in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "key", "text")), strict=True):
                leaves = [(k, None, leaf) if isinstance(seg, str) else (k, seg, b"") for k, seg in enumerate(bpe.segments(text)) for leaf in (halves(seg.encode(), leaf_bytes) if isinstance(seg, str) else [b""])]
                yield pa.RecordBatch.from_pylist([{"doc_id": doc_id, "key": key, "leaf": n, "segment": k, "added": a, "text": x} for n, (k, a, x) in enumerate(leaves)], CUT)

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer_path)
        for piece in pieces_of(batches, "text", 1 << 20):
            done = [bpe.leaf(x) if a is None else Tokens(b"", [a], [0], [0]) for a, x in zip(piece.column("added").to_pylist(), piece.column("text").to_pylist(), strict=True)]
            blobs = [pa.array([np.array(getattr(t, f), np.int32).tobytes() for t in done], pa.binary()) for f in ("ids", "starts", "ends")]
            yield pa.RecordBatch.from_arrays([*piece.columns, *blobs], names=[*piece.schema.names, "ids", "starts", "ends"])

    def join(key, group):
        bpe = loaded(tokenizer_path)
        rows = sorted(group.to_pylist(), key=lambda r: r["leaf"])
        ids, by_segment = array("i"), {}
        for r in rows:
            by_segment.setdefault(r["segment"], []).append(Tokens(r["text"], *(np.frombuffer(r[f], np.int32).tolist() for f in ("ids", "starts", "ends"))))
        for k in sorted(by_segment):
            ids.extend(bpe.joined(by_segment[k]).ids)
        return pa.table({"doc_id": pa.array([rows[0]["doc_id"]], pa.int64()), "ids": _int_lists([ids]), "decoded": pa.array([bpe.decode(ids)], pa.string())})

    whole = rows.where(F.octet_length("text") <= long_bytes).mapInArrow(short, RESULT)
    keyed = rows.where(F.octet_length("text") > long_bytes).withColumn("key", F.monotonically_increasing_id())
    leaves = keyed.mapInArrow(cut, "doc_id long, key long, leaf int, segment int, added int, text binary")
    # Dealt out by leaf, so that the leaves of one long text are encoded by different tasks.
    dealt = leaves.repartition(F.xxhash64("key", "leaf")).mapInArrow(encode_leaves, "doc_id long, key long, leaf int, segment int, added int, text binary, ids binary, starts binary, ends binary")
    return whole.unionByName(dealt.groupBy("key").applyInArrow(join, RESULT))


CUT = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("leaf", pa.int32()), ("segment", pa.int32()), ("added", pa.int32()), ("text", pa.binary())])


def decode(tokens: DataFrame, tokenizer_path: str, ids_col: str = "ids") -> DataFrame:
    """The input with a column ``decoded``: the tokens' names joined by a space, as the library gives them for a
    file without a decoder. Null ids decode to null."""

    @F.pandas_udf("string")
    def names(ids):
        bpe = loaded(tokenizer_path)
        return ids.map(lambda x: None if x is None else bpe.decode(x))

    return tokens.withColumn("decoded", names(ids_col))


def digests(encoded: DataFrame) -> DataFrame:
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256) of what encode() returns."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
