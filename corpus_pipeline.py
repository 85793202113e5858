"""The corpus pipeline: quality rules, SimHash near-dedup, suffix-array dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. run() writes each stage's rows
to the shared folder and reads them again, so that a lost executor costs one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import bpe, common, decontaminate, neardup, repeats, rules
from corpusmill.llm.queries import tokenizer


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars made that of the text as it now is."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the decision list learned from the labels."""
    learned = rules.learn(docs, common.table(spark, sf_dir, "labels"))
    return rules.judged(docs, learned).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more between sets of five-word shingles: by SimHash
    through the pigeonhole index and an exact check, then exactly for pairs whose fingerprints lie further apart."""
    return neardup.near_deduplicated(docs, shingle_words=5, percent=80, max_bits=4)


def string_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 100 bytes that start earlier too; one may be left empty."""
    return _sized(repeats.deduplicated(docs, length=100))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words in ten-word windows of benchmark items."""
    return _sized(decontaminate.decontaminated(docs, common.table(spark, sf_dir, "benchmark"), window=10))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of ids and decoded text."""
    found = bpe.encode(docs, tokenizer("word_bpe_49k.json"))
    return bpe.digests(found)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", string_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding", encoding),
]
#: SQL can express neither the learned list nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    where = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{k}")
        docs = spark.read.parquet(f"{where}/{k}")
    return docs
