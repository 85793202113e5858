"""Composition, running totals, statistics, vectors, sources and sinks on known answers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import stats as S
from corpusmill.operators import compose as C
from corpusmill.operators import vectors as V
from corpusmill.operators.prefix import running_total
from corpusmill.sources import readers, sinks


def test_running_total_equals_a_loop(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("abc"), rnd.randrange(-50, 20_000), rnd.randrange(9)) for _ in range(500)] + [("a", None, 3), ("a", 7, 1), ("a", 7, 2)]
    got = running_total(spark.createDataFrame(rows, "k string, o long, v long"), ["k"], "o", F.col("v"), "t", width=64).collect()
    low = lambda o: -1 << 60 if o is None else o
    for r in got:
        if r["o"] is not None:
            assert r["t"] == sum(v for k, o, v in rows if k == r["k"] and low(o) < low(r["o"]))


def test_emission_repeats_and_truncates(spark):
    docs = spark.createDataFrame([("s", 1, 4), ("s", 2, 3), ("t", 3, 10)], "source string, doc_id long, n_words long")
    plan = spark.createDataFrame([("s", 16.5, 7), ("t", 10.0, 10), ("u", 5.0, 0)], "source string, target double, words long")
    got = sorted((r["source"], r["pass_no"], r["doc_id"], r["n_take"]) for r in C.emit(docs, plan).collect())
    assert got == [("s", 0, 1, 4), ("s", 0, 2, 3), ("s", 1, 1, 4), ("s", 1, 2, 3), ("s", 2, 1, 2), ("t", 0, 3, 10)]


def test_registry_refuses_what_is_wrong(spark):
    row = lambda name, share, kind="spine": (name, kind, share, 1, 1, False)
    with pytest.raises(ValueError, match="sum to 1"):
        C.registry(spark, [row("a", 0.5)])
    with pytest.raises(ValueError, match="unknown slices"):
        C.registry(spark, [row("a", 1.0, "nothing")])
    with pytest.raises(ValueError, match="twice"):
        C.registry(spark, [row("a", 0.5), row("a", 0.5)])
    with pytest.raises(KeyError, match="known: a"):
        C.get_source([row("a", 1.0)], "b")


def test_required_rounds_half_to_even_and_shares_are_trimmed(spark):
    df = spark.createDataFrame([(0.25,), (0.35,), (1.0,), (0.12345,)], "s double")
    assert [r["v"] for r in df.select(C.required(F.col("s"), 10).alias("v")).collect()] == [2, 4, 10, 1]
    assert [r["v"] for r in df.select(C.format_share(F.col("s")).alias("v")).collect()] == ["25%", "35%", "100%", "12.345%"]


def test_selectors(spark):
    df = spark.createDataFrame([("Jane Doe", "Folk tales", ["doe"], []), (None, "Folk tales", [], ["TALE"]), ("Jane", "x", [], []), ("Jane", "x", None, None)], "a string, b string, sa array<string>, sb array<string>")
    assert [r["v"] for r in df.select(C.matches(*map(F.col, ("a", "b", "sa", "sb"))).alias("v")).collect()] == [True, True, False, False]


def test_examples_are_padded_and_masked(spark):
    df = spark.createDataFrame([([1, 2, 3], [4, 5])], "p array<int>, c array<int>")
    ids, labels = C.sft_example(F.col("p"), F.col("c"))
    (r,) = df.select(ids.alias("i"), labels.alias("l")).collect()
    assert r["i"] == [1, 2, 3, 4, 5] + [0] * 27 and r["l"] == [-100, -100, 4, 5, -100] + [-100] * 27


def test_tail_split(spark):
    got = C.tail_split(spark.range(25).withColumn("s", F.col("id") % 2), ["s"], "id", 0.2).where("is_val").collect()
    assert sorted(r["id"] for r in got) == [21, 22, 23, 24]


def test_sign_test_and_estimates(spark):
    df = spark.createDataFrame([(0, 0), (1, 9), (5, 5), (300, 400)], "n long, p long")
    got = [r["v"] for r in df.select(S.sign_test(F.col("n"), F.col("p")).alias("v")).collect()]
    exact = lambda a, b: min(1.0, 2 * sum(math.comb(a + b, k) for k in range(min(a, b) + 1)) / 2 ** (a + b))
    assert got[0] is None and got[1:] == [pytest.approx(exact(a, b), rel=1e-9) for a, b in ((1, 9), (5, 5), (300, 400))]
    one = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (None,)], "v double").agg(F.avg("v").alias("m"), S.sem(F.col("v")).alias("s")).first()
    assert (one["m"], one["s"]) == (0.5, pytest.approx(0.2886751, abs=1e-7))
    assert spark.createDataFrame([(3.0,)], "v double").agg(S.sem(F.col("v")).alias("s")).first()["s"] == 0.0


def test_verdicts(spark):
    df = spark.createDataFrame([(-0.8, 0.1), (0.8, 0.1), (0.1, 0.1), (None, None)], "m double, s double")
    assert [r["v"] for r in df.select(S.paired_change(F.col("m"), F.col("s")).alias("v")).collect()] == ["better", "worse", "no change", "n/a"]
    t = spark.createDataFrame([(0.0, 0.0), (-1.0, 0.0), (1.0, 10.0), (5.0, 1.0)], "m double, s double")
    assert [r["v"] for r in t.select(S.paired_t_verdict(F.col("m"), F.col("s"), F.lit(9)).alias("v")).collect()] == ["not interpretable", "better", "not interpretable", "worse"]
    c = spark.createDataFrame([(0.5, None, 0.1), (0.5, 0.5, 0.0), (0.6, 0.5, None), (0.6, 0.5, 0.1), (0.9, 0.5, 0.1), (0.1, 0.5, 0.1)], "x double, c double, e double")
    assert [r["v"] for r in c.select(S.chance_verdict(F.col("x"), F.col("c"), F.col("e")).alias("v")).collect()] == ["no baseline", "AT CHANCE", "no stderr", "AT CHANCE", "above chance", "below chance"]


def test_neighbours_do_not_depend_on_blocks(spark):
    rnd = random.Random(3)
    p = spark.createDataFrame([(k, [rnd.gauss(0, 1) for _ in range(5)]) for k in range(90)], "id long, v array<double>").repartition(4)
    a, b = ({tuple(r) for r in V.neighbours(p, p, 3, block_rows=n).collect()} for n in (4096, 20))
    assert a == b and len(a) == 270
    assert V.neighbours(p, p.limit(0), 3).count() == 0


def test_torus_and_mesh_differ(spark):
    df = spark.createDataFrame([(0, 10), (0, 99), (5, 5)], "a long, b long")
    got = [(r["t"], r["m"]) for r in df.select(V.hops(F.col("a"), F.col("b"), 11, 10).alias("t"), V.hops(F.col("a"), F.col("b"), 11, 10, False).alias("m")).collect()]
    assert got == [(1, 10), (1, 9), (0, 0)]


def test_jsonl_statuses_and_sinks(spark, tmp_path):
    lines = ['{"text": "a"}', '["text"]', '{"x": 1}', '{"text": "b', '{"text": 5}', '{"text": ""}', ""]
    got = readers.jsonl(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r["status"] for r in got] == ["ok", "skipped", "empty", "skipped", "skipped", "empty", "skipped"]
    docs = spark.createDataFrame([(1, "a"), (2, " "), (3, None), (4, "b")], "id long, text string")
    sinks.write_documents(docs, f"{tmp_path}/out")
    assert sorted(r["text"] for r in spark.read.json(f"{tmp_path}/out").collect()) == ["a", "b"]
    with pytest.raises(Exception, match="already exists"):
        sinks.write_documents(docs, f"{tmp_path}/out")
    with pytest.raises(PermissionError):
        sinks.assert_not_protected(f"{tmp_path}/out/x", [str(tmp_path)])
    assert sinks.content_digest(docs).first() == sinks.content_digest(docs.orderBy(F.desc("id"))).first() != sinks.content_digest(docs.limit(3)).first()


def test_strict_trajectories(spark, tmp_path):
    (tmp_path / "ok.jsonl").write_text('{"step": 500, "val_loss": 5.0}\n{"step": 1000, "val_loss": 4.0}\n')
    (tmp_path / "bad.jsonl").write_text('{"step": 500, "val_loss": 5.0}\n{"step": 10')
    (tmp_path / "none.jsonl").write_text("")
    assert [(r["step"], r["val_loss"]) for r in readers.read_trajectory(spark, f"{tmp_path}/ok.jsonl").collect()] == [(500, 5.0), (1000, 4.0)]
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        readers.read_trajectory(spark, f"{tmp_path}/bad.jsonl").collect()
    with pytest.raises(ValueError, match="no rows"):
        readers.read_trajectory(spark, f"{tmp_path}/none.jsonl")


def test_prompts_requests_and_metrics(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"prompts": [{"id": "1", "probe": "x", "text": "t"}]}')
    (tmp_path / "lex.txt").write_text("# note\nBad\n\n worse \n")
    assert [tuple(r) for r in readers.read_prompts(spark, f"{tmp_path}/p.json").collect()] == [("1", "x", "t")]
    assert [r["term"] for r in readers.read_lexicon(spark, f"{tmp_path}/lex.txt").collect()] == ["bad", "worse"]
    m = spark.createDataFrame([({"acc,none": 0.5, "acc_norm,none": 0.7},)], "m map<string,double>")
    assert m.select(readers.metric(F.col("m"), "acc").alias("v")).first()["v"] == 0.5
    paths = spark.createDataFrame([("a/step_9.bin",), ("a/step10.bin",), ("a/none.bin",)], "path string")
    assert tuple(readers.newest(paths).first()) == ("a/step10.bin", 10)
