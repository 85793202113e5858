"""What must not be left out, whatever the names and the order of the columns."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import compose as C
from corpusmill.operators import prefix
from corpusmill.plans import registry
from corpusmill.sources import readers

QUERIES = ["pca_2d", "derangement_p", "events_hourly_stream", "linear_probe", "corpus_digest", "doc_longest_repeat"]


def test_running_totals_of_sparse_orders_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(prefix, "MOST_BLOCKS", 64)
    monkeypatch.setattr(prefix, "STEPS", 8)
    rnd = random.Random(4)
    rows = [(rnd.choice("aab"), rnd.choice([rnd.randrange(-(1 << 60), 1 << 60), rnd.randrange(50)]), rnd.randrange(9)) for _ in range(600)] + [("b", 1 << 61, 1), ("b", None, 2)]
    df = spark.createDataFrame(rows, "k string, o long, v long").withColumns({c: F.lit(1) for c in ("block", "value", "sum", "base", "at", "key_0", "_block", "_value", "_base", "_n")})
    got = prefix.running_total(df, ["k"], "o", F.col("v"), "t").collect()
    low = lambda o: -(1 << 62) if o is None else o
    assert len(got) == len(rows) and all(r["_base"] == r["block"] == 1 for r in got)
    assert all(r["t"] == sum(v for k, o, v in rows if k == r["k"] and low(o) < low(r["o"])) for r in got if r["o"] is not None)


def test_sparse_orders_spread_over_blocks(spark):
    ids = spark.range(50_000).select(F.xxhash64("id").alias("o"))
    sizes = [r["count"] for r in ids.groupBy(prefix._block(ids, "o", 4096).alias("b")).count().collect()]
    assert 1000 < len(sizes) <= 4096 and max(sizes) < 500


def test_blend_refuses_what_cannot_be_supplied(spark):
    reg = C.registry(spark, [("a", "spine", 0.5, 2, 1, False), ("b", "spine", 0.5, 1, 1, False)])
    available = spark.createDataFrame([("a", 100, 130), ("b", 200, 260)], "source string, words long, tokens long")
    assert C.largest_budget(reg, available).first()["budget"] == 520
    plan = {r["source"]: (r["want"], round(r["target"], 6)) for r in C.plan_blend(reg, available, F.lit(500)).collect()}
    assert plan == {"a": (250, 192.307692), "b": (250, 192.307692)}
    with pytest.raises(Exception, match="cannot supply"):
        C.plan_blend(reg, available, F.lit(600)).collect()


def test_json_lines_of_any_kind(spark):
    lines = ['{"text": "a"}', '{"other": {"text": "x"}, "text": 5}', '{"text": "a"} trailing', '{"text": "\\t"}', '{"text": null}', "{}", "[1]", "", '{"text": ["a"]}', '{"other": "\\"text\\": \\"x\\""}', None]
    got = readers.jsonl(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [tuple(r) for r in got] == [("a", "ok"), ("", "skipped"), ("", "skipped"), ("", "empty"), ("", "empty"), ("", "empty"), ("", "skipped"), ("", "skipped"), ("", "skipped"), ("", "empty"), ("", "skipped")]


def test_longest_repeat_equals_a_loop(spark):
    rnd = random.Random(8)
    rows = [[rnd.choice("ab"[: rnd.randint(1, 2)]) for _ in range(rnd.randint(0, 40))] for _ in range(150)] + [[], ["a"], ["a"] * 20, list("abcabcabc"), [str(k) for k in range(30)]]

    def loop(row):
        return max((n for n in range(1, len(row)) if max(Counter(tuple(row[k : k + n]) for k in range(len(row) - n + 1)).values()) > 1), default=0)

    got = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, w array<string>").select("k", T.longest_repeat("w").alias("n")).collect()
    assert {r["k"]: r["n"] for r in got} == {k: loop(r) for k, r in enumerate(rows)}


@pytest.mark.parametrize("name", QUERIES)
def test_queries_without_sql_give_rows(spark, name):
    assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
