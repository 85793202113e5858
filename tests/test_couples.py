"""Couples of words against loops, over many buckets and small parts."""

import random
from collections import Counter
from itertools import combinations
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import couples as P
from corpusmill.plans import registry


def sets_of(spark, rows):
    return spark.createDataFrame([(k, [(w, t) for w, t in r.items()]) for k, r in rows.items()], "row long, words array<struct<w:string,times:int>>")


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    found = {k: {w: rnd.choice([0, 0, 1, 3]) for w in {f"w{int(rnd.expovariate(0.05))}" for _ in range(rnd.randint(0, 30))}} for k in range(120)}
    return found | {k: {"common": 0, "copy": 2, "w1": 1} for k in range(200, 260)} | {300: {"only": 1}, 301: {}}


def test_couple_counts_equal_a_loop(spark, rows, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_COUPLES", 100)
    numbered = P.Numbered(sets_of(spark, rows))
    words = {r["id"]: (r["w"], r["c"]) for r in numbered.words.collect()}
    held = Counter(w for r in rows.values() for w in r)
    assert sorted(words) == list(range(len(held))) and dict(words.values()) == held
    got = {}
    for r in P.couple_counts(numbered).collect():
        assert (r["n_x"], r["n_y"]) == (words[r["x"]][1], words[r["y"]][1])
        assert got.setdefault(tuple(sorted((words[r["x"]][0], words[r["y"]][0]))), r["n_ab"]) == r["n_ab"]
    assert got == Counter(c for r in rows.values() for c in combinations(sorted(r), 2))


def test_best_partners_equal_a_loop(spark, rows, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_COUPLES", 100)
    n = len(rows)
    held = Counter(w for r in rows.values() for w in r)
    both = Counter(c for r in rows.values() for c in combinations(sorted(r), 2))

    def score(x, y):
        p = both[tuple(sorted((x, y)))] / n
        return max(0.0, log(p * n * n / (held[x] * held[y])) / -log(p)) if p < 1 else 0.0

    want = {k: sum(t * max((score(x, y) for y, u in r.items() if u == 0), default=0.0) for x, t in r.items() if t) for k, r in rows.items()}
    got = {r["row"]: r["total"] for r in P.best_partners(P.Numbered(sets_of(spark, rows)), n).collect()}
    assert got.keys() == {k for k, r in rows.items() if r}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_parts_keep_words_whole_and_sums_equal(monkeypatch):
    monkeypatch.setattr(P, "COUPLES_AT_ONCE", 7)
    rnd = np.random.default_rng(5)
    ids, cost = rnd.integers(0, 9, 200), rnd.integers(1, 4, 200)
    parts = list(P.by_word(ids, cost))
    assert sorted(np.concatenate(parts).tolist()) == list(range(200))
    assert len({int(i) for p in parts for i in np.unique(ids[p])}) == sum(len(np.unique(ids[p])) for p in parts)
    for places in parts:
        found, times = P.couples_of(places, cost, lambda at: ids[at] * 10 + cost[at])
        assert dict(zip(found.tolist(), times.tolist(), strict=True)) == Counter((ids[places] * 10 + cost[places]).tolist())


@pytest.mark.parametrize("name", ["npmi", "pair_scores"])
def test_couples_of_sets_are_not_rows(spark, name):
    """Neither a row for each couple of each set nor a shuffle by couples: nothing is dealt out by two words."""
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(slice(" not in plan and "Aggregate [a#" not in plan


def test_no_sets(spark):
    empty = P.Numbered(sets_of(spark, {}))
    assert P.couple_counts(empty).count() == P.best_partners(empty, 0).select(F.col("row")).count() == 0
