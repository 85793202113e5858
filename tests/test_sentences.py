"""Sentences as they stand in the text."""

from pyspark.sql import functions as F

from corpusmill.functions import text as T


def test_sentences_keep_digits_at_their_ends(spark):
    want = [f"{k} and {k}." for k in range(25)]
    rows = spark.createDataFrame([(" " + " \n ".join(want) + " tail 26 ",)], "t string")
    assert rows.select(T.sentences(F.col("t"))).first()[0] == [*want, "tail 26"]
