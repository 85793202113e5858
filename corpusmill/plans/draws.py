"""Queries over seeded sampling and learned probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import sampling as M
from corpusmill.plans.base import Registry, table
from corpusmill.plans.geometry import HEIGHT, L_SQL, WIDTH, log_sum_exp, logits, points
from corpusmill.plans.texts import SENTENCES_SQL, TURNS_SQL, documents, turn_pairs

R = Registry()
U_SQL = "(CAST('0x' || substr(md5({k}), 1, 8) AS BIGINT) + 0.5) / 4294967296.0"
IDS_SQL = "list_transform(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda x: CAST(len(x) + 3 AS INTEGER))"


@R.query(f"""WITH i AS (SELECT doc_id, {IDS_SQL} AS ids FROM documents), w AS (SELECT doc_id, ids, unnest(range(0, 3)) AS win FROM i WHERE len(ids) > 33),
s AS (SELECT doc_id, win, ids, CAST(floor({U_SQL.format(k="'w-' || doc_id || '-' || win")} * (len(ids) - 33)) AS INTEGER) AS st FROM w)
SELECT doc_id, CAST(win AS INTEGER) AS win, md5(array_to_string(ids[st + 1:st + 32], ' ')) AS x, md5(array_to_string(ids[st + 2:st + 33], ' ')) AS y FROM s""")
def sampled_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three windows of 32 tokens of each document that is long enough (a feature: the number asked for)."""
    ids = documents(spark, sf_dir).select("doc_id", F.transform(T.words_of(F.col("text")), lambda w: F.length(w) + 3).alias("ids")).where(F.size("ids") > 33)
    text = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), " "))
    return M.windows(ids, "doc_id", "ids", 32, 3).select("doc_id", F.col("window").alias("win"), text("x").alias("x"), text("y").alias("y"))


@R.query(f"""WITH p AS (SELECT label AS cell, count(*) / (SELECT count(*) FROM embeddings) AS p FROM embeddings GROUP BY label), c AS (SELECT cell, p, sum(p) OVER (ORDER BY cell) AS hi FROM p), b AS (SELECT cell, p, hi - p AS lo, hi FROM c),
d AS (SELECT t AS trial, {U_SQL.format(k="'b-' || t || '-' || i")} AS u FROM range(0, 20) a(t), range(0, 400) e(i)), h AS (SELECT trial, cell, count(*) / 400 AS q FROM d JOIN b ON u >= lo AND u < hi GROUP BY ALL)
SELECT t AS trial, round(sum(abs(coalesce(q, 0) - p)) / 2, 6) AS tv FROM range(0, 20) a(t) CROSS JOIN p LEFT JOIN h ON h.trial = t AND h.cell = p.cell GROUP BY t""")
def bootstrap_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of 20 samples of 400 draws from the distribution of labels."""
    c = points(spark, sf_dir).groupBy(F.col("label").alias("cell")).agg(F.count("*").alias("c"))
    p = c.crossJoin(F.broadcast(c.agg(F.sum("c").alias("t")))).select("cell", (F.col("c") / F.col("t")).alias("p"))
    return M.bootstrap_floor(spark, p, 400, 20).select("trial", F.round("tv", 6).alias("tv"))


@R.query(f"""WITH {L_SQL}, c AS (SELECT cell, ln(sum(exp(x))) AS lse FROM l GROUP BY cell), g AS (SELECT i AS draw, cell, round(lse, 9) - ln(-ln({U_SQL.format(k="'c-' || i || '-' || cell")})) AS s FROM c, range(0, 40) t(i)),
o AS (SELECT draw, arg_max(cell, s) AS cell FROM g GROUP BY draw), n AS (SELECT b.draw, b.cell AS origin, a.id, a.x - ln(-ln({U_SQL.format(k="'t-' || b.draw || '-' || a.id")})) AS s FROM l a JOIN o b
 ON least(abs(a.cell % 11 - b.cell % 11), 11 - abs(a.cell % 11 - b.cell % 11)) + least(abs(a.cell // 11 - b.cell // 11), 10 - abs(a.cell // 11 - b.cell // 11)) <= 2)
SELECT draw, origin, arg_max(id, s) AS id FROM n GROUP BY draw, origin""")
def topological_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = logits(spark, sf_dir)
    lse = log_sum_exp(x).withColumn("lse", F.round("lse", 9))
    return M.topological_draw(x, lse, 40, WIDTH, HEIGHT, 2)


NAMES_SQL = "list_distinct(list_filter(list_transform(flatten(list_transform({s}, lambda s: list_filter(regexp_split_to_array(s, '\\s+'), lambda q: q <> '')[2:])), lambda x: regexp_extract(x, '^([A-Z][a-z]+)(?:[^A-Za-z0-9_À-ÿŒœ]|$)', 1)), lambda x: x <> ''))"


@R.query(f"""WITH {TURNS_SQL}, n AS (SELECT conv_id, turn, {NAMES_SQL.format(s=SENTENCES_SQL.format(t='prompt'))} AS a, {NAMES_SQL.format(s=SENTENCES_SQL.format(t='completion'))} AS b FROM pairs)
SELECT conv_id, turn, CAST(len(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))) AS BIGINT) AS n_new FROM n""")
def new_proper_nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in a continuation that its prompt lacks."""
    new = F.array_except(T.proper_nouns(F.col("completion")), T.proper_nouns(F.col("prompt")))
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", F.size(new).cast("long").alias("n_new"))


@R.query()
def linear_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by label of a multinomial logistic regression on a stratified quarter; scaling is learned on the rest."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    p = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"))
    rank = F.percent_rank().over(W.partitionBy("label").orderBy(F.xxhash64("vec_id")))
    p = p.withColumn("test", rank >= 0.75)
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(p.where("not test"))
    model = LogisticRegression(family="multinomial", maxIter=30, regParam=0.01).fit(scaler.transform(p.where("not test")))
    got = model.transform(scaler.transform(p.where("test")))
    return got.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("prediction") == F.col("label")).cast("int")), 6).alias("accuracy"))


QUERIES, ORACLE = R.queries, R.oracle
