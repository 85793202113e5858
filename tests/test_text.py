"""Text scalars on literals, and wrong versions that must differ."""

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T


def values(spark, rows, column, schema="t string"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)
    return [r["v"] for r in df.withColumn("n", F.monotonically_increasing_id()).select("n", column.alias("v")).orderBy("n").collect()]


def test_normalise_is_idempotent(spark):
    raw = ["a  \r\nb\r\r\n\n\n\nc\t\n", "\n\nx\n\n", "", None, "a  \nb"]
    once = values(spark, raw, T.normalise(F.col("t")))
    assert once == ["a\nb\n\nc", "x", "", None, "a \nb"]
    assert values(spark, once, T.normalise(F.col("t"))) == once


@pytest.mark.parametrize(("text", "want", "status"), [
    ("head\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\nbody\n*** END OF THIS PROJECT GUTENBERG EBOOK X ***\ntail", "body", "both"),
    ("*** start of this project gutenberg etext y\nbody", "body", "start-only"),
    ("body\n***END OF THE PROJECT GUTENBERG EBOOK", "body", "end-only"),
    ("x *** START OF THE PROJECT GUTENBERG EBOOK", "x *** START OF THE PROJECT GUTENBERG EBOOK", "none"),
])
def test_boilerplate(spark, text, want, status):
    (got,) = values(spark, [text], T.strip_boilerplate(F.col("t")))
    assert (got["text"], got["status"]) == (want, status)


@pytest.mark.parametrize(("text", "want", "removed"), [
    ("Produced by David Price\n\nProse", "Prose", 1),
    ("produced by charity, or charity by faith\nProse", "produced by charity, or charity by faith\nProse", 0),
    ("produced by Nature herself\nProse", "produced by Nature herself\nProse", 0),
    ("this ebook was produced by: D\nx.y@example.org\n\nProse\nProduced by David", "Prose\nProduced by David", 2),
    ("\n\nProse", "\n\nProse", 0),
    ("Transcriber's note\n", "", 1),
])
def test_front_matter(spark, text, want, removed):
    (got,) = values(spark, [text], T.strip_front_matter(F.col("t")))
    assert (got["text"], got["removed"]) == (want, removed)


def test_words_split_at_unicode_space(spark):
    assert values(spark, ["a b c\x1cd e", "", "  "], T.word_count(F.col("t"))) == [5, 0, 0]


def test_stems_and_stop_words(spark):
    assert values(spark, ["The classes of dogs and bus gas miss"], T.behaviour_content(F.col("t"))) == [["classe", "dog", "bus", "gas", "miss"]]
    assert values(spark, ["It's the Dogs' day"], T.improv_content(F.col("t"))) == [["dogs'", "day"]]


def test_sentences_and_names(spark):
    text = 'He met Ana. "Go!" she said. Ana saw Bob\'s cat? yes'
    assert values(spark, [text], T.sentences(F.col("t"))) == [['He met Ana.', '"Go!"', 'she said.', "Ana saw Bob's cat?", "yes"]]
    assert values(spark, [text], T.proper_nouns(F.col("t"))) == [["Ana", "Bob"]]


def test_markers(spark):
    found = values(spark, ["ONCE UPON A TIME a tiny cat named Rex", "a cat named rex", "The end."], T.markers_found(F.col("t")))
    assert found == [["once_upon_a_time", "little_X_named", "named_proper"], [], ["the_end_terminal"]]


def test_repeat_rates(spark):
    rows = [(["a", "b", "c", "d", "a", "b", "c", "d"],), (["a", "b", "c"],), (["a", "a", "b"],)]
    assert values(spark, rows, T.repeat_rate(F.col("t")), "t array<string>") == [pytest.approx(0.2), None, None]
    assert values(spark, rows, T.longest_repeat(F.col("t")), "t array<string>") == [4, 0, 1]
    assert values(spark, rows, T.local_repeat(F.col("t")), "t array<string>") == [0.5, 0.0, pytest.approx(1 / 3)]


def test_think_blocks(spark):
    block = "<think>\noffer: a\naccept: b:c\nadd: d\nstakes: up\nHandback: e\noffer: z\n</think>\n"
    ok, missing, bad = values(spark, [block, block.replace("add: d\n", ""), block.replace("up", "sideways")], T.parse_think(F.col("t")))
    assert ok.asDict() == {"offer": "z", "accept": "b:c", "add": "d", "stakes": "up", "handback": "e"} and missing is None and bad is None


def test_truncate_and_agreement(spark):
    df = spark.createDataFrame([([5, 2, 7], [5, 3]), ([1], [1, 9]), ([], [])], "a array<int>, b array<int>")
    got = df.select(T.truncate_at(F.col("a")).alias("x"), T.leading_agreement(F.col("a"), F.col("b")).alias("n")).collect()
    assert [(r["x"], r["n"]) for r in got] == [([5], 1), ([1], 1), ([], 0)]
