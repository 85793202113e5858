"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds (multiplies) those of its letters, permuted
(rotated) by their place; a text's vector bundles (adds) those of its trigrams, a language's prototype those of its
documents. A text gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import pieces_of

DIMENSIONS = 512
SEED = 20240229
SHARD_BYTES = 1 << 20
#: Cells of a count matrix held at once; more texts go to the next matrix.
MATRIX_CELLS = 1 << 23
#: Languages that a model may have; each costs DIMENSIONS integers on the driver and in every task.
MOST_LANGUAGES = 4096
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1 << 14)
def letter_vector(code: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=[SEED, code])).integers(0, 2, DIMENSIONS, np.int8) * np.int8(2) - np.int8(1)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct trigrams of the texts (rows of three code points), and for each occurrence its text and trigram;
    at last, whether each text has a letter. A run of other characters, and either end, is one space."""
    lowered = [f" {x.lower()} " for x in texts]
    code = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in lowered])
    letter = letters()[code]
    has = np.zeros(len(texts), bool)
    has[owner[letter]] = True
    keep = letter | np.r_[True, letter[:-1] | (owner[1:] != owner[:-1])]
    code, owner, letter = code[keep], owner[keep], letter[keep]
    code = np.where(letter, code, 32).astype(np.int64)
    own = owner[:-2] == owner[2:] if len(owner) > 2 else np.empty(0, bool)
    alphabet, at = np.unique(code, return_inverse=True) if len(code) else (code, code)
    size = len(alphabet)
    joint = (at[:-2] * size + at[1:-1]) * size + at[2:]
    joint, owner = joint[own], owner[:-2][own]
    if size**3 <= 1 << 23:
        seen = np.bincount(joint, minlength=size**3) > 0
        distinct, place = np.flatnonzero(seen), np.cumsum(seen)[joint] - 1
    else:
        distinct, place = np.unique(joint, return_inverse=True)
    rows = np.stack([alphabet[distinct // (size * size)], alphabet[distinct // size % size], alphabet[distinct % size]], axis=1) if size else np.empty((0, 3), np.int64)
    return rows, owner, place, has


def trigram_vectors(rows: np.ndarray, dtype) -> np.ndarray:
    codes, at = np.unique(rows, return_inverse=True)
    base = np.stack([letter_vector(int(c)) for c in codes]) if len(codes) else np.empty((0, DIMENSIONS), np.int8)
    at = at.reshape(rows.shape)
    bound = np.roll(base, 2, axis=1)[at[:, 0]]
    bound *= np.roll(base, 1, axis=1)[at[:, 1]]
    bound *= base[at[:, 2]]
    return bound.astype(dtype)


def bundles(texts: list[str], groups: np.ndarray | None = None, n: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Exact integer vectors of texts, or of groups of texts, and whether each text has a letter."""
    rows, owner, place, has = trigrams(texts)
    n = len(texts) if groups is None else n
    target = owner if groups is None else groups[owner]
    out = np.zeros((n, DIMENSIONS), np.int64)
    dtype = np.float32 if len(owner) < 1 << 24 else np.float64  # sums of +1 and -1 stay exact
    vectors = trigram_vectors(rows, dtype)
    step = max(1, MATRIX_CELLS // max(1, len(rows)))
    order = np.argsort(target, kind="stable") if groups is not None else np.arange(len(target))
    ends = np.searchsorted(target[order], np.arange(n + 1))
    for a in range(0, n, step):
        b = min(n, a + step)
        own = order[ends[a] : ends[b]]
        counts = np.bincount((target[own] - a) * len(rows) + place[own], minlength=(b - a) * len(rows)).reshape(b - a, len(rows))
        out[a:b] = np.rint(counts.astype(dtype) @ vectors).astype(np.int64)
    return out, has


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes by language over all rows with a language; null texts add nothing. Sums are of integers, so the
    order of rows does not matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for piece in pieces_of(batches, "text", SHARD_BYTES):
            names = piece.column("lang").to_pylist()
            known = {x: k for k, x in enumerate(dict.fromkeys(names))}
            sums, _ = bundles([x or "" for x in piece.column("text").to_pylist()], np.array([known[x] for x in names]), len(known))
            for x, k in known.items():
                total[x] = total.get(x, 0) + sums[k]
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([x.tolist() for x in total.values()], pa.list_(pa.int64()))], names=["lang", "sums"])

    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    parts = rows.mapInArrow(run, "lang string, sums array<long>").select("lang", F.posexplode("sums"))
    total = parts.groupBy("lang", "pos").agg(F.sum("col").alias("s"))
    found = total.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias("sums")).limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return {r["lang"]: np.array(r["sums"], np.int64) for r in sorted(found, key=lambda r: r["lang"])}


def predict(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """The columns ``keep`` with lang_pred and score, from the text alone, in one pass.

    Null texts, texts without a letter and an empty model give ``und`` and score 0. score is the cosine, at least
    0; of equal cosines the first language by name wins. An empty table gives an empty result.
    """
    names = list(model)
    protos = np.stack([model[x] for x in names]).astype(np.float64) if names else np.zeros((1, DIMENSIONS))
    protos /= np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-12)
    shared = docs.sparkSession.sparkContext.broadcast((names, protos))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, protos = shared.value
        for piece in pieces_of(batches, "_text", SHARD_BYTES):
            vectors, has = bundles([x or "" for x in piece.column("_text").to_pylist()])
            cosine = vectors @ protos.T / np.maximum(np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True), 1e-12)
            best = cosine.argmax(axis=1)
            known = has & bool(names)
            score = np.where(known, np.clip(cosine[np.arange(len(best)), best], 0.0, 1.0), 0.0)
            langs = [names[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(langs, pa.string()), pa.array(score)], names=[*piece.schema.names[:-1], "lang_pred", "score"])

    rows = docs.select(*(keep or []), F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "lang_pred string", "score double"])
    return rows.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether a document is kept from learning; a null id has no fold."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == fold
