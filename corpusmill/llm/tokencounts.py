"""Token counts of byte-level BPE by rank-synchronous merging of ragged numpy arrays.

The distinct pre-tokens of a batch are held as one flat array of symbols with the sequence each belongs to. In a
round every sequence finds its lowest-ranked pair and merges all places of it at once; sequences without a
mergeable pair leave. What is left of each sequence are its tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import pieces_of

#: Fixed value: the pre-token pattern of byte-level vocabularies of this kind.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
REMEMBERED = 400_000
NEVER = np.int64(1 << 40)


class ByteBpe:
    """Merge ranks of a byte-level vocabulary as sorted pair codes; symbols are token ids."""

    def __init__(self, path: str):
        from corpusmill.llm.bpe import byte_letters

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.byte_ids = np.array([vocab[c] for c in byte_letters()], np.int64)
        codes = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(codes)
        self.codes, self.ranks = codes[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None
        self.counts: dict[str, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left << 32 | right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], NEVER)

    def merged_lengths(self, sequences: list[bytes]) -> np.ndarray:
        """Tokens of each (non-empty) byte sequence."""
        size = np.array([len(x) for x in sequences], np.int64)
        symbol = self.byte_ids[np.frombuffer(b"".join(sequences), np.uint8)]
        owner = np.repeat(np.arange(len(sequences)), size)
        result = np.zeros(len(sequences), np.int64)
        rank = self._pair_ranks(symbol, owner)
        while len(symbol):
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, start)
            n = np.diff(np.r_[start, len(symbol)])
            if (done := lowest == NEVER).any():
                result[owner[start[done]]] = n[done]
                stay = np.repeat(~done, n)
                symbol, owner, rank = symbol[stay], owner[stay], rank[stay]
                lowest, n = lowest[~done], n[~done]
                if not len(symbol):
                    break
            low = np.repeat(lowest, n)
            hit = rank == low
            # Overlapping places (a run of one symbol): from the left, every second.
            spot = np.flatnonzero(hit)
            run = np.flatnonzero(np.r_[True, np.diff(spot) > 1])
            take = spot[(np.arange(len(spot)) - np.repeat(run, np.diff(np.r_[run, len(spot)]))) % 2 == 0]
            symbol[take] = self.made[rank[take]]
            keep = np.ones(len(symbol), bool)
            keep[take + 1] = False
            # Only pairs next to a merge have a new rank.
            changed = np.zeros(len(symbol), bool)
            changed[take] = True
            changed[np.maximum(take - 1, 0)] = True
            symbol, owner, rank, changed = symbol[keep], owner[keep], rank[keep], changed[keep]
            # A place before a merge may itself have been merged away; its own survivor precedes it.
            at = np.flatnonzero(changed | np.r_[changed[1:], False])
            rank[at] = self._pair_ranks_at(symbol, owner, at)
        return result

    def _pair_ranks(self, symbol: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return self._pair_ranks_at(symbol, owner, np.arange(len(symbol)))

    def _pair_ranks_at(self, symbol: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        after = np.minimum(at + 1, len(symbol) - 1)
        inside = (at + 1 < len(symbol)) & (owner[after] == owner[at])
        return np.where(inside, self.rank(symbol[at], symbol[after]), NEVER)

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text; an added token's string counts as one."""
        known, parts = self.counts, []
        extra = [0] * len(texts)
        for k, text in enumerate(texts):
            if self.cut is not None and any(x in text for x in self.added):
                stretches = self.cut.split(text)
                extra[k] = len(stretches) - 1
                parts.append([x for s in stretches for x in PATTERN.findall(s)])
            else:
                parts.append(PATTERN.findall(text))
        fresh = {x for part in parts for x in part if x not in known}
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh = {x for part in parts for x in part}
        batch = list(fresh)
        for at in range(0, len(batch), 1 << 16):
            own = batch[at : at + (1 << 16)]
            known.update(zip(own, self.merged_lengths([x.encode() for x in own]).tolist(), strict=True))
        get = known.__getitem__
        return [sum(map(get, part)) + more for part, more in zip(parts, extra, strict=True)]


@lru_cache(maxsize=2)
def loaded(path: str) -> ByteBpe:
    return ByteBpe(path)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one for each input row, in one pass without a shuffle.

    Null and empty texts have no bytes and no tokens; null and repeated doc_ids are kept as they are; other
    columns are ignored; an empty table gives an empty result. A pre-token of any length is merged whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(tokenizer_path)
        for piece in pieces_of(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("n_bytes"), pa.array(bpe.count(piece.column("text").to_pylist()), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
