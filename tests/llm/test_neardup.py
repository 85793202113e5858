"""Near-duplicates of the pipeline's stage against all pairs."""

import random

import corpus_pipeline
from corpusmill.llm import neardup


def brute_similarity(a, b, n=5):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def brute_kept(texts, least=0.8):
    up = list(range(len(texts)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for j in range(len(texts)):
        for i in range(j):
            if brute_similarity(texts[i], texts[j]) >= least:
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {k for k in range(len(texts)) if top(k) == k}


def near_copies(rnd, n_groups=25):
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8)))
    texts, passage = ["", "one two", "One  two"], [word() for _ in range(30)]
    for g in range(n_groups):
        t = [word() for _ in range(rnd.randint(20, 200))] + passage * (g % 2)
        texts.append(" ".join(t))
        for _ in range(6):
            u = list(t)
            for _ in range(rnd.randint(1, max(1, len(u) // 40))):
                u[rnd.randrange(len(u))] = word()
            texts.append(" ".join(u))
    rnd.shuffle(texts)
    return texts


def test_stage_links_all_pairs_of_similarity_four_fifths(spark, docs):
    texts = near_copies(random.Random(3))
    got = corpus_pipeline.near_dedup(spark, docs(list(enumerate(texts))), "")
    want = brute_kept(texts)
    assert len(want) < len(texts) - 50
    assert {r["doc_id"] for r in got.collect()} == want


def test_common_shingles_change_the_order_only(spark, docs, monkeypatch):
    monkeypatch.setattr(neardup, "SAMPLE", 1)
    texts = near_copies(random.Random(4))
    got = neardup.near_deduplicated(docs(list(enumerate(texts))))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(brute_kept(texts))
