"""Sentences of more words than fit a fixed slice."""

from pyspark.sql import functions as F

from corpusmill.functions import text as T


def test_names_late_in_a_very_long_sentence_are_found(spark):
    rows = spark.createDataFrame([("Ana " + "x " * (1 << 20) + "Bob",), ("Ana",), ("",)], "t string")
    assert [r[0] for r in rows.select(T.proper_nouns(F.col("t"))).collect()] == [["Bob"], [], []]
