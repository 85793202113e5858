"""The pipeline's near-dedup goes through the SimHash index; its fingerprints against all pairs."""

import random

import corpus_pipeline
import numpy as np
from corpusmill.llm import neardup
from corpusmill.llm.components import connected_components


def texts_of(rnd):
    found = []
    for _ in range(40):
        words = [str(rnd.randrange(10**6)) for _ in range(rnd.randint(60, 400))]
        found += [" ".join(words), " ".join([*words, "end"]), " ".join(words[:-1] + ["last"] * (rnd.randrange(2) + 1))]
    return found


def test_close_fingerprints_have_the_components_of_all_pairs(spark):
    sets = [neardup.shingle_set(t.encode(), 5) for t in texts_of(random.Random(6))]
    rows = [(neardup.node_of(s), neardup.fingerprint(s)) for s in sets]
    rows += [(7, rows[0][1]), (8, rows[0][1]), rows[0]]
    got = {r["node"]: r["component"] for r in connected_components(neardup.close_fingerprints(spark.createDataFrame(rows, "node long, fp long"), 4)).collect()}
    low = dict.fromkeys((n for n, _ in rows), 0) | {n: n for n, _ in rows}
    pairs = [(a, b) for a, x in rows for b, y in rows if a < b and bin((x ^ y) & (2**64 - 1)).count("1") <= 4]
    for _ in rows:
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    assert pairs and got == {n: low[n] for pair in pairs for n in pair}


def test_fingerprint_is_the_majority_of_each_bit():
    found = np.array([-1, 1, 3, 0], np.int64)
    assert neardup.fingerprint(found) == 1
    assert neardup.fingerprint(found[:1]) == -1


def test_the_stage_checks_what_the_index_links(spark, docs, monkeypatch):
    asked = []
    monkeypatch.setattr(neardup, "links", lambda distinct, plan, tau, buckets, f=neardup.links: asked.append((distinct.count(), tau, len(plan))) or f(distinct, plan, tau, buckets))
    # Without the lists of least hashes, the index and the exact path find all.
    monkeypatch.setattr(neardup, "neighbours", lambda sets: sets.select("node", "node").toDF("a", "b").where("false"))
    got = corpus_pipeline.near_dedup(spark, docs([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "a b c d e q r s t")]), "")
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3]
    assert asked and asked[0][1] == 4 and asked[0][2] >= 1
