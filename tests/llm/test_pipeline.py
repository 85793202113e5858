"""The pipeline's stages against brute force, each on what the one before it kept."""

import hashlib
import random

import public_tokenizers
import pytest
from test_llm_operators import brute_components, brute_fingerprint, brute_repeats, brute_statistics
from tokenizers import Tokenizer

import corpus_pipeline
from corpusmill.llm import decontaminate

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(6)
    line = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    shared, item = line(60), line(25)
    texts = [None, "", "few words"]
    for k in range(140):
        t = line(rnd.randint(30, 90))
        texts.append({0: t.replace(" ", "## "), 3: t.replace(" ", "## "), 1: f"{t} {shared} {line(20)}", 2: f"{t} {item} tail"}.get(k % 7, t))
    texts += texts[5:15]
    where = tmp_path_factory.mktemp("tables")
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(k, 0 if "##" in (t or "") else 1, 0) for k, t in enumerate(texts) if t], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, item), (2, line(12))], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where), texts, item


def test_stages_equal_brute_force(spark, tables, tmp_path):
    where, texts, item = tables
    docs, kept = spark.read.parquet(f"{where}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, where).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r["doc_id"]: r.asDict() for r in docs.collect()})
        if k < 4:
            assert docs.columns == COLUMNS and all(r["n_chars"] == len(r["text"]) for r in kept[k].values())
    assert set(kept[0]) == {k for k, t in enumerate(texts) if not brute_statistics(t)[-1] and "##" not in t}
    groups = brute_components([(i, brute_fingerprint(r["text"], 4)) for i, r in kept[0].items()], 4)
    assert set(kept[1]) == {i for i, c in groups.items() if i == c}
    gone = brute_repeats([(i, r["text"].encode()) for i, r in kept[1].items()])
    assert {i: r["text"] for i, r in kept[2].items()} == {i: left.decode() for i, (_, left) in gone.items()}
    asked = decontaminate.phrases([("1", item)], 10)
    assert all(item not in r["text"] for r in kept[3].values()) and any(item in r["text"] for r in kept[2].values()) and len(asked.lengths) == 16
    assert {i: r["text"] for i, r in kept[3].items() if item not in kept[2][i]["text"]} == {i: r["text"] for i, r in kept[2].items() if item not in r["text"]}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, r in kept[4].items():
        ids = t.encode(kept[3][i]["text"], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert set(kept[4]) == set(kept[3]) == set(kept[1])


def test_run_applies_all_stages(spark, tables):
    got = corpus_pipeline.run(spark, tables[0])
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < got.count() < 120
