"""Queries over trajectories, paired comparisons, noise floors and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import stats as S
from corpusmill.functions import text as T
from corpusmill.plans.base import Registry, table
from corpusmill.plans.texts import BEHAVIOUR_SQL, TURNS_SQL, documents, turn_pairs

R = Registry()
TYPES_SQL = "types AS (SELECT DISTINCT event_type FROM events), ab AS (SELECT min(event_type) AS a, max(event_type) AS b FROM types)"
CURVES_SQL = f"{TYPES_SQL}, c AS (SELECT event_type AS run, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS step, avg(value) AS v FROM events GROUP BY 1, 2)"
PAIR_SQL = f"{CURVES_SQL}, p AS (SELECT x.step, y.v - x.v AS delta, x.v AS va, y.v AS vb FROM c x JOIN c y USING (step), ab WHERE x.run = ab.a AND y.run = ab.b)"


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, step, v): the mean value of each event type and day."""
    step = F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))).cast("long").alias("step")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run"), step).agg(F.avg("value").alias("v"))


def first_and_last(c: DataFrame) -> tuple[DataFrame, DataFrame]:
    ends = F.broadcast(c.agg(F.min("run").alias("a"), F.max("run").alias("b")))  # one row
    both = c.crossJoin(ends)
    return both.where("run = a").select("step", F.col("v").alias("va")), both.where("run = b").select("step", F.col("v").alias("vb"))


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = first_and_last(curves(spark, sf_dir))
    return a.join(b, "step").select("step", "va", "vb", (F.col("vb") - F.col("va")).alias("delta"))


@R.query(f"WITH {PAIR_SQL} SELECT CAST(step AS BIGINT) AS step, round(delta, 6) AS delta FROM p")
def traj_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deltas(spark, sf_dir).select("step", F.round("delta", 6).alias("delta"))


@R.query(f"""WITH {CURVES_SQL}, x AS (SELECT step FROM c, ab WHERE run = a AND step % 3 <> 0), y AS (SELECT step FROM c, ab WHERE run = b AND step % 4 <> 0)
SELECT CAST(coalesce(x.step, y.step) AS BIGINT) AS step, CASE WHEN x.step IS NULL THEN 'only B' WHEN y.step IS NULL THEN 'only A' ELSE 'both' END AS side FROM x FULL JOIN y ON x.step = y.step""")
def traj_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = first_and_last(curves(spark, sf_dir))
    joined = a.where("step % 3 <> 0").join(b.where("step % 4 <> 0"), "step", "full_outer")
    return joined.select("step", F.when(F.col("va").isNull(), "only B").when(F.col("vb").isNull(), "only A").otherwise("both").alias("side"))


@R.query(f"""WITH {PAIR_SQL}, n AS (SELECT count(*) FILTER (delta < 0) AS neg, count(*) FILTER (delta > 0) AS pos FROM p),
k AS (SELECT neg, pos, unnest(range(0, least(neg, pos) + 1)) AS k FROM n)
SELECT neg, pos, round(least(1.0, 2 * sum(exp(lgamma(neg + pos + 1) - lgamma(k + 1) - lgamma(neg + pos - k + 1) - (neg + pos) * ln(2)))), 6) AS p FROM k GROUP BY neg, pos""")
def traj_sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = deltas(spark, sf_dir).agg(F.count_if(F.col("delta") < 0).alias("neg"), F.count_if(F.col("delta") > 0).alias("pos"))
    return n.select("neg", "pos", F.round(S.sign_test(F.col("neg"), F.col("pos")), 6).alias("p"))


@R.query(f"WITH {PAIR_SQL} SELECT count(*) AS n, round(arg_max(delta, step), 6) AS endpoint, round(avg(delta), 6) AS mean, round(stddev_samp(delta), 6) AS sd, count(*) FILTER (delta < 0) AS n_better FROM p")
def traj_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("delta")
    return deltas(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.max_by("delta", "step"), 6).alias("endpoint"), F.round(F.avg(d), 6).alias("mean"), F.round(F.stddev_samp(d), 6).alias("sd"), F.count_if(d < 0).alias("n_better"))


def wobbles(c: DataFrame) -> DataFrame:
    """Absolute difference of neighbours within each run; a run's first row has none."""
    return c.withColumn("wobble", F.abs(F.col("v") - F.lag("v").over(W.partitionBy("run").orderBy("step")))).where("wobble is not null")


@R.query(f"WITH {CURVES_SQL}, w AS (SELECT run, abs(v - lag(v) OVER (PARTITION BY run ORDER BY step)) AS w FROM c) SELECT run, round(median(w), 6) AS median_wobble, count(w) AS n FROM w GROUP BY run")
def run_wobble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wobbles(curves(spark, sf_dir)).groupBy("run").agg(F.round(F.median("wobble"), 6).alias("median_wobble"), F.count("*").alias("n"))


@R.query(f"""WITH {PAIR_SQL}, w AS (SELECT run, abs(v - lag(v) OVER (PARTITION BY run ORDER BY step)) AS w FROM c), f AS (SELECT median(w) AS floor FROM w, ab WHERE run IN (a, b)),
m AS (SELECT avg(delta) AS mean, stddev_samp(delta) / sqrt(count(*)) AS se FROM p)
SELECT round(mean, 6) AS mean, round(se, 6) AS se, round(floor, 6) AS floor, CASE WHEN se = 0 AND mean = 0 THEN 'identical' WHEN se = 0 THEN 'constant offset' WHEN abs(mean) <= floor THEN 'within wobble' WHEN abs(mean) <= 2 * se THEN 'not interpretable' WHEN mean < 0 THEN 'B better' ELSE 'A better' END AS verdict FROM m, f""")
def run_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last run against the first, unpaired: the wobble floor first, then two standard errors."""
    c = curves(spark, sf_dir)
    ends = F.broadcast(c.agg(F.min("run").alias("a"), F.max("run").alias("b")))
    floor = wobbles(c.crossJoin(ends).where("run = a or run = b")).agg(F.median("wobble").alias("floor"))
    m = deltas(spark, sf_dir).agg(F.avg("delta").alias("mean"), S.sem(F.col("delta")).alias("se")).crossJoin(F.broadcast(floor))
    mean, se = F.col("mean"), F.col("se")
    verdict = F.when((se == 0) & (mean == 0), "identical").when(se == 0, "constant offset").when(F.abs(mean) <= F.col("floor"), "within wobble").when(F.abs(mean) <= 2 * se, "not interpretable").when(mean < 0, "B better").otherwise("A better")
    return m.select(F.round(mean, 6).alias("mean"), F.round(se, 6).alias("se"), F.round("floor", 6).alias("floor"), verdict.alias("verdict"))


#: Signals of a user's turn: (conversation, signal, value), of even and odd turns as two runs.
SIGNALS_SQL = f"""{TURNS_SQL}, sg AS (SELECT conv_id, turn, len(completion) * 1.0 AS n_chars, len(regexp_extract_all(lower(completion), '[a-z0-9'']+')) * 1.0 AS n_words FROM pairs),
l AS (SELECT conv_id, turn // 2 % 2 AS arm, 'n_chars' AS signal, n_chars AS v FROM sg UNION ALL SELECT conv_id, turn // 2 % 2, 'n_words', n_words FROM sg),
pp AS (SELECT conv_id, signal, arm, avg(v) AS v FROM l GROUP BY ALL), d AS (SELECT x.conv_id, x.signal, y.v - x.v AS d FROM pp x JOIN pp y ON x.conv_id = y.conv_id AND x.signal = y.signal AND x.arm = 0 AND y.arm = 1)"""


def signal_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("completion")
    wide = turn_pairs(spark, sf_dir).select("conv_id", (F.floor(F.col("turn") / 2) % 2).alias("arm"), F.length(c).cast("double").alias("n_chars"), F.size(T.words_of(c)).cast("double").alias("n_words"))
    means = wide.unpivot(["conv_id", "arm"], ["n_chars", "n_words"], "signal", "v").groupBy("conv_id", "signal").agg(F.avg(F.when(F.col("arm") == 0, F.col("v"))).alias("a"), F.avg(F.when(F.col("arm") == 1, F.col("v"))).alias("b"))
    return means.select("conv_id", "signal", (F.col("b") - F.col("a")).alias("d")).where("d is not null")


@R.query(f"""WITH {SIGNALS_SQL}, m AS (SELECT signal, avg(d) AS mean, coalesce(stddev_samp(d) / sqrt(count(*)), 0) AS se, count(*) AS n FROM d GROUP BY signal)
SELECT signal, round(mean, 6) AS mean, round(1.96 * se, 6) AS min_detectable, n, CASE WHEN mean - 1.96 * se <= 0 AND mean + 1.96 * se >= 0 THEN 'no change' WHEN mean < 0 THEN 'better' ELSE 'worse' END AS verdict FROM m""")
def paired_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = signal_deltas(spark, sf_dir).groupBy("signal").agg(F.avg("d").alias("mean"), S.sem(F.col("d")).alias("se"), F.count("*").alias("n"))
    return m.select("signal", F.round("mean", 6).alias("mean"), F.round(S.Z95 * F.col("se"), 6).alias("min_detectable"), "n", S.paired_change(F.col("mean"), F.col("se")).alias("verdict"))


@R.query(f"""WITH {SIGNALS_SQL}, m AS (SELECT signal, avg(d) AS mean, coalesce(stddev_samp(d) / sqrt(count(*)), 0) AS se FROM d GROUP BY signal), f AS (SELECT 'n_words' AS signal, 0.5 AS floor),
r AS (SELECT m.*, abs(mean) / nullif(floor, 0) AS ratio FROM m LEFT JOIN f USING (signal))
SELECT signal, round(ratio, 6) AS ratio, CASE WHEN ratio IS NULL THEN 'no floor' WHEN ratio <= 1.2 THEN 'NOT INTERPRETABLE' WHEN mean - 1.96 * se <= 0 AND mean + 1.96 * se >= 0 THEN 'below paired detection' WHEN mean < 0 THEN 'better' ELSE 'worse' END AS label FROM r""")
def floor_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = signal_deltas(spark, sf_dir).groupBy("signal").agg(F.avg("d").alias("mean"), S.sem(F.col("d")).alias("se"))
    floors = spark.createDataFrame([("n_words", 0.5)], "signal string, floor double")
    r = m.join(F.broadcast(floors), "signal", "left").withColumn("ratio", F.abs("mean") / F.nullif(F.col("floor"), F.lit(0.0)))
    return r.select("signal", F.round("ratio", 6).alias("ratio"), S.floor_label(F.col("ratio"), S.paired_change(F.col("mean"), F.col("se"))).alias("label"))


@R.query(f"""WITH {SIGNALS_SQL}, m AS (SELECT signal, avg(d) AS mean, stddev_pop(d) AS sd, count(*) AS n, count(*) FILTER (d < 0) AS n_down, count(*) FILTER (d > 0) AS n_up FROM d GROUP BY signal),
t AS (SELECT *, CASE WHEN sd > 0 THEN abs(mean) / (sd / sqrt(n)) WHEN mean <> 0 THEN 1e300 ELSE 0 END AS t FROM m)
SELECT signal, n, n_down, n_up, round(t, 6) AS t, CASE WHEN t <= 2.576 THEN 'not interpretable' WHEN mean < 0 THEN 'better' ELSE 'worse' END AS verdict FROM t""")
def paired_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    m = signal_deltas(spark, sf_dir).groupBy("signal").agg(F.avg(d).alias("mean"), F.stddev_pop(d).alias("sd"), F.count("*").alias("n"), F.count_if(d < 0).alias("n_down"), F.count_if(d > 0).alias("n_up"))
    t = F.when(F.col("sd") > 0, F.abs("mean") / (F.col("sd") / F.sqrt("n"))).when(F.col("mean") != 0, F.lit(1e300)).otherwise(0.0)
    return m.select("signal", "n", "n_down", "n_up", F.round(t, 6).alias("t"), S.paired_t_verdict(F.col("mean"), F.col("sd"), F.col("n")).alias("verdict"))


@R.query("""WITH a AS (SELECT n_name AS key, CAST(n_regionkey AS VARCHAR) AS v FROM nation WHERE n_nationkey % 3 <> 0), b AS (SELECT n_name AS key, CASE WHEN n_nationkey % 4 = 0 THEN 'changed' ELSE CAST(n_regionkey AS VARCHAR) END AS v FROM nation WHERE n_nationkey % 5 <> 0)
SELECT coalesce(a.key, b.key) AS key, a.v AS left_value, b.v AS right_value, coalesce(a.key, b.key) < 'G' AS blocking FROM a FULL JOIN b ON a.key = b.key WHERE a.v IS DISTINCT FROM b.v""")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose values differ between two manifests; a missing key is null; some keys block a comparison."""
    nation = table(spark, sf_dir, "nation")
    v = F.col("n_regionkey").cast("string")
    a = nation.where("n_nationkey % 3 <> 0").select(F.col("n_name").alias("key"), v.alias("left_value"))
    b = nation.where("n_nationkey % 5 <> 0").select(F.col("n_name").alias("key"), F.when(F.col("n_nationkey") % 4 == 0, "changed").otherwise(v).alias("right_value"))
    return a.join(b, "key", "full_outer").where(~F.col("left_value").eqNullSafe(F.col("right_value"))).select("key", "left_value", "right_value", (F.col("key") < "G").alias("blocking"))


@R.query("""WITH s AS (SELECT source, avg(quality) AS score, stddev_samp(quality) / sqrt(count(*)) AS se, CASE WHEN source = 'src3' THEN NULL ELSE 0.8 END AS chance FROM labels JOIN documents USING (doc_id) GROUP BY source)
SELECT source, round(score, 6) AS score, round((score - chance) / nullif(se, 0), 6) AS z, CASE WHEN chance IS NULL THEN 'no baseline' WHEN coalesce(se, 0) <= 0 THEN CASE WHEN score = chance THEN 'AT CHANCE' ELSE 'no stderr' END
 WHEN abs((score - chance) / se) < 2 THEN 'AT CHANCE' WHEN score > chance THEN 'above chance' ELSE 'below chance' END AS verdict FROM s""")
def chance_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "labels").join(documents(spark, sf_dir).select("doc_id", "source"), "doc_id").groupBy("source").agg(F.avg("quality").alias("score"), (F.stddev_samp("quality") / F.sqrt(F.count("*"))).alias("se"))
    s = scored.withColumn("chance", F.when(F.col("source") != "src3", F.lit(0.8)))
    return s.select("source", F.round("score", 6).alias("score"), F.round((F.col("score") - F.col("chance")) / F.nullif(F.col("se"), F.lit(0.0)), 6).alias("z"), S.chance_verdict(F.col("score"), F.col("chance"), F.col("se")).alias("verdict"))


SPECS = [("quality", "acc,none"), ("toxic", "acc,none"), ("missing", "acc,none")]


@R.query("""WITH r AS (SELECT 'quality' AS task, avg(quality) AS score FROM labels UNION ALL SELECT 'toxic', avg(toxic) FROM labels), s AS (SELECT * FROM (VALUES ('quality'), ('toxic'), ('missing')) t(task))
SELECT task, 'acc' AS metric, round(score, 6) AS score, score IS NULL AS missing FROM s LEFT JOIN r USING (task)""")
def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics asked for against results, which name them "metric,filter"; a task without a result is reported."""
    spec = spark.createDataFrame(SPECS, "task string, key string")
    labels = table(spark, sf_dir, "labels").agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"))
    maps = labels.select(F.explode(F.create_map(F.lit("quality"), F.create_map(F.lit("acc,none"), F.col("quality")), F.lit("toxic"), F.create_map(F.lit("acc,none"), F.col("toxic")))).alias("task", "metrics"))
    results = maps.select("task", F.explode("metrics").alias("name", "score")).select("task", F.split_part("name", F.lit(","), F.lit(1)).alias("metric"), "score")
    asked = spec.select("task", F.split_part("key", F.lit(","), F.lit(1)).alias("metric"))
    return asked.join(results, ["task", "metric"], "left").select("task", "metric", F.round("score", 6).alias("score"), F.col("score").isNull().alias("missing"))


@R.query("SELECT item_id % 4 AS task, count(*) AS n_requests, CASE WHEN item_id % 4 = 3 THEN 0 ELSE count(*) FILTER (n > 41) END AS n_truncated, CAST(max(n) AS BIGINT) AS longest FROM (SELECT item_id, len(string_split(text, ' ')) AS n FROM benchmark) GROUP BY item_id % 4")
def truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of more than 40 + 1 tokens by task; the rolling task is exempt."""
    n = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 4).alias("task"), F.size(F.split("text", " ")).alias("n"))
    counted = n.groupBy("task").agg(F.count("*").alias("n_requests"), F.count_if(F.col("n") > 41).alias("over"), F.max("n").cast("long").alias("longest"))
    return counted.select("task", "n_requests", F.when(F.col("task") == 3, F.lit(0).cast("long")).otherwise(F.col("over")).alias("n_truncated"), "longest")


P_SQL = BEHAVIOUR_SQL.format(w="regexp_extract_all(lower(prompt), '[a-z0-9'']+')")
C_SQL = BEHAVIOUR_SQL.format(w="regexp_extract_all(lower(completion), '[a-z0-9'']+')")


@R.query(f"""WITH {TURNS_SQL}, s AS (SELECT conv_id, turn, list_distinct({P_SQL}) AS p, {C_SQL} AS c FROM pairs), e AS (SELECT conv_id, CASE WHEN len(p) > 0 THEN len(list_intersect(p, c)) / len(p) END AS v FROM s),
m AS (SELECT conv_id % 3 AS probe, conv_id, avg(v) AS m FROM e GROUP BY conv_id) SELECT probe, round(avg(m), 6) AS mean, round(coalesce(stddev_samp(m) / sqrt(count(m)), 0), 6) AS sem, count(m) AS n FROM m WHERE probe <> 2 GROUP BY probe HAVING count(m) > 0""")
def prompt_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean engagement by probe: means of conversations are the observations; one probe is left out."""
    v = turn_pairs(spark, sf_dir).select((F.col("conv_id") % 3).alias("probe"), "conv_id", T.engagement(F.col("prompt"), F.col("completion")).alias("v"))
    m = v.groupBy("probe", "conv_id").agg(F.avg("v").alias("m"))
    return m.where("probe <> 2").groupBy("probe").agg(F.round(F.avg("m"), 6).alias("mean"), F.round(S.sem(F.col("m")), 6).alias("sem"), F.count("m").alias("n")).where("n > 0")


BUCKETS_SQL = "b AS (SELECT user_id % 50 AS w, CASE WHEN h < 32 THEN 0 WHEN h < 64 THEN 1 WHEN h < 128 THEN 2 WHEN h < 256 THEN 3 WHEN h < 512 THEN 4 END AS bucket, value FROM (SELECT *, event_id % 512 AS h FROM events)), m AS (SELECT w, bucket, avg(value) AS m FROM b GROUP BY ALL)"


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("w"), S.bucket_of(F.col("event_id") % 512, S.EDGES).alias("bucket"), "value")
    return e.groupBy("w", "bucket").agg(F.avg("value").alias("m")).groupBy("bucket").agg(F.avg("m").alias("mean"), S.sem(F.col("m")).alias("sem"), F.count("m").alias("n"))


@R.query(f"WITH {BUCKETS_SQL} SELECT CAST(bucket AS INTEGER) AS bucket, round(avg(m), 6) AS mean, round(stddev_samp(m) / sqrt(count(m)), 6) AS sem, count(m) AS n FROM m GROUP BY bucket")
def position_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets(spark, sf_dir).select("bucket", F.round("mean", 6).alias("mean"), F.round("sem", 6).alias("sem"), "n")


@R.query(f"WITH {BUCKETS_SQL}, x AS (SELECT bucket, avg(m) AS mean, CASE bucket WHEN 0 THEN 32 WHEN 1 THEN 32 WHEN 2 THEN 64 WHEN 3 THEN 128 ELSE 256 END AS width FROM m GROUP BY bucket) SELECT CASE WHEN count(mean) = count(*) AND sum(width) = 512 THEN round(sum(mean * width) / sum(width), 6) END AS pooled FROM x")
def pooled_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over buckets weighted by their widths; null if one has no mean or they do not tile the window."""
    widths = F.array(*[F.lit(b - a) for a, b in zip(S.EDGES, S.EDGES[1:], strict=False)])
    x = buckets(spark, sf_dir).withColumn("width", F.get(widths, F.col("bucket")))
    return x.agg(F.when((F.count("mean") == F.count("*")) & (F.sum("width") == S.EDGES[-1]), F.round(F.sum(F.col("mean") * F.col("width")) / F.sum("width"), 6)).alias("pooled"))


@R.query("""WITH c AS (SELECT event_type AS cond, user_id % 6 AS source, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT cond, source, n / sum(n) OVER (PARTITION BY cond) AS share FROM c), b AS (SELECT source, share AS base FROM s WHERE cond = (SELECT min(event_type) FROM events))
SELECT cond, source, round(share, 6) AS share, round(share - base, 6) AS lift FROM s JOIN b USING (source)""")
def lift_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each source under each condition, and its lift over the first condition."""
    c = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("cond"), (F.col("user_id") % 6).alias("source")).agg(F.count("*").alias("n"))
    s = c.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("cond")))
    first = F.broadcast(c.agg(F.min("cond").alias("first")))
    base = s.crossJoin(first).where("cond = first").select("source", F.col("share").alias("base"))
    return s.join(base, "source").select("cond", "source", F.round("share", 6).alias("share"), F.round(F.col("share") - F.col("base"), 6).alias("lift"))


QUERIES, ORACLE = R.queries, R.oracle
