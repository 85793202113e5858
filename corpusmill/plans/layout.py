"""Queries over grid layouts: purity, occupancy, neighbours by hops, placements and their cost; agreement and floors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import stats as S
from corpusmill.functions import text as T
from corpusmill.operators import vectors as V
from corpusmill.operators.prefix import running_total
from corpusmill.operators.sampling import uniform
from corpusmill.plans.base import Registry, quoted, table
from corpusmill.plans.geometry import CELLS, CENTRE_SQL, E_SQL, HEIGHT, HOPS_SQL, NEAR_SQL, WIDTH, centroids, histogram, labelled, logits, points
from corpusmill.plans.measures import C_SQL, P_SQL, PAIR_SQL, SIGNALS_SQL, deltas, signal_deltas
from corpusmill.plans.texts import MARKERS_SQL, TURNS_SQL, turn_pairs

R = Registry()
HIST_SQL = "h AS (SELECT vec_id % 110 AS cell, label, count(*) AS n FROM embeddings GROUP BY ALL)"


def md5_uniform(key: str) -> str:
    """SQL of sampling.uniform: a number between 0 and 1 by an md5."""
    return f"((CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) + 0.5) / 4294967296.0)"


@R.query(f"WITH {HIST_SQL}, c AS (SELECT cell, max(n) AS top, sum(n) AS n FROM h GROUP BY cell) SELECT round(sum(top) / sum(n), 6) AS purity, count(*) AS n_cells FROM c")
def plurality_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of points that have the commonest label of their cell."""
    c = histogram(spark, sf_dir).groupBy("cell").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return c.agg(F.round(F.sum("top") / F.sum("n"), 6).alias("purity"), F.count("*").alias("n_cells"))


@R.query(f"WITH {HIST_SQL}, c AS (SELECT cell, sum(n) AS n FROM h GROUP BY cell) SELECT count(*) AS occupied, 112 - count(*) AS empty, round(avg(n), 6) AS mean_load, CAST(max(n) AS BIGINT) AS max_load, round(sum(n) / (112 * 1024), 6) AS load FROM c")
def cell_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells in use of 112, their loads, and the share of their capacity of 1,024 each that is used."""
    c = histogram(spark, sf_dir).groupBy("cell").agg(F.sum("n").alias("n"))
    return c.agg(F.count("*").alias("occupied"), (112 - F.count("*")).alias("empty"), F.round(F.avg("n"), 6).alias("mean_load"), F.max("n").alias("max_load"), F.round(F.sum("n") / (112 * 1024), 6).alias("load"))


@R.query(f"WITH {NEAR_SQL}, d AS (SELECT id, count(DISTINCT nl) AS n FROM nb GROUP BY id) SELECT count(*) AS n_points, round(avg(n), 6) AS distinct_labels FROM d")
def distinct_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different labels among the nearest points, averaged over all points."""
    d = labelled(spark, sf_dir).groupBy("id").agg(F.count_distinct("nl").alias("n"))
    return d.agg(F.count("*").alias("n_points"), F.round(F.avg("n"), 6).alias("distinct_labels"))


@R.query(f"""WITH {NEAR_SQL}, p AS (SELECT avg(CASE WHEN label = nl THEN 1.0 ELSE 0.0 END) AS purity FROM nb), s AS (SELECT sum(x * x) AS chance FROM (SELECT count(*) / (SELECT count(*) FROM embeddings) AS x FROM embeddings GROUP BY label))
SELECT round(purity, 6) AS purity, round(chance, 6) AS chance, round((purity - chance) / (1 - chance), 6) AS headroom FROM p, s""")
def cosine_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purity of the cosine graph, its chance, and the share of the room above chance that it fills."""
    p = labelled(spark, sf_dir).agg(F.avg((F.col("label") == F.col("nl")).cast("int")).alias("purity"))
    n = points(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    s = n.agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("chance"))
    room = S.retention(F.col("purity"), F.col("chance"), F.lit(1.0), F.col("chance"))
    return p.crossJoin(F.broadcast(s)).select(F.round("purity", 6).alias("purity"), F.round("chance", 6).alias("chance"), F.round(room, 6).alias("headroom"))  # one row


LAYOUTS = (1, 7, 13)


@R.query("""WITH l AS (SELECT unnest([1, 7, 13]) AS layout), h AS (SELECT layout, vec_id // layout % 110 AS cell, label, count(*) AS n FROM embeddings, l GROUP BY ALL), c AS (SELECT layout, cell, max(n) AS top, sum(n) AS n FROM h GROUP BY ALL), p AS (SELECT layout, sum(top) / sum(n) AS purity FROM c GROUP BY layout)
SELECT round(avg(purity), 6) AS mean, round(stddev_samp(purity), 6) AS sd, round(min(purity), 6) AS low, round(max(purity), 6) AS high, count(*) AS n FROM p""")
def layout_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plurality purity over repeated layouts: mean, standard deviation and ends."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.explode(F.array(*map(F.lit, LAYOUTS))).alias("layout"))
    h = e.groupBy("layout", (F.floor(F.col("vec_id") / F.col("layout")) % CELLS).alias("cell"), "label").agg(F.count("*").alias("n"))
    p = h.groupBy("layout", "cell").agg(F.max("n").alias("top"), F.sum("n").alias("n")).groupBy("layout").agg((F.sum("top") / F.sum("n")).alias("purity"))
    return p.agg(*[F.round(f("purity"), 6).alias(name) for f, name in ((F.avg, "mean"), (F.stddev_samp, "sd"), (F.min, "low"), (F.max, "high"))], F.count("*").alias("n"))


@R.query("SELECT vec_id % 110 AS cell, count(*) AS n, md5(string_agg(vec_id, ' ' ORDER BY vec_id)) AS ids, count(*) <= 1024 AS fits FROM embeddings GROUP BY 1")
def packed_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell's points by id, and whether its capacity of 1,024 holds them."""
    ids = F.array_sort(F.collect_list("id"))
    return logits(spark, sf_dir).groupBy("cell").agg(F.count("*").alias("n"), F.md5(F.array_join(ids.cast("array<string>"), " ")).alias("ids"), (F.count("*") <= 1024).alias("fits"))


def near_cells(spark: SparkSession, k: int) -> DataFrame:
    """(a, b, k): the ``k`` nearest other cells of each, ties by a hash. 110 cells: a constant."""
    a, b = (spark.range(CELLS).withColumnRenamed("id", x) for x in "ab")
    pairs = a.crossJoin(F.broadcast(b)).where("a <> b").withColumn("s", V.hops(F.col("a"), F.col("b"), WIDTH, HEIGHT) + 0.5 * uniform(F.lit("j"), F.col("a"), F.col("b")))
    return pairs.withColumn("k", F.row_number().over(W.partitionBy("a").orderBy("s", "b"))).where(F.col("k") <= k).drop("s")


JITTER_SQL = f"c AS (SELECT unnest(range(0, 110)) AS cell), js AS (SELECT a.cell AS a, b.cell AS b, {HOPS_SQL} + 0.5 * {md5_uniform("'j-' || a.cell || '-' || b.cell")} AS s FROM c a, c b WHERE a.cell <> b.cell), jk AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY s, b) AS k FROM js QUALIFY k <= 6)"


@R.query(f"WITH {JITTER_SQL} SELECT a, b, k FROM jk")
def jittered_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six nearest other cells of each by hops, ties in a hashed order."""
    return near_cells(spark, 6).select("a", "b", F.col("k").cast("long").alias("k"))


@R.query(f"""WITH {JITTER_SQL}, m AS (SELECT vec_id % 110 AS cell, list(label ORDER BY vec_id) AS pool FROM embeddings GROUP BY 1),
d AS (SELECT vec_id AS id, pool[1 + CAST(floor({md5_uniform("'d-' || vec_id || '-' || jk.b")} * len(pool)) AS BIGINT)] AS drawn FROM embeddings JOIN jk ON jk.a = vec_id % 110 JOIN m ON m.cell = jk.b), n AS (SELECT id, count(DISTINCT drawn) AS n FROM d GROUP BY id)
SELECT count(*) AS n_points, round(avg(n), 6) AS diversity FROM n""")
def direction_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different labels among one hashed draw from each of a point's six nearest other cells, averaged over points.

    Draws go by rank within the cell, so no cell's points meet in one row; cells without points give none.
    """
    p = points(spark, sf_dir).select("id", "cell", "label")
    size = p.groupBy("cell").agg(F.count("*").alias("n"))
    pool = running_total(p, ["cell"], "id", F.lit(1), "rank").select(F.col("cell").alias("b"), F.col("rank"), F.col("label").alias("drawn"))
    asked = p.join(F.broadcast(near_cells(spark, 6)), F.col("a") == F.col("cell")).join(F.broadcast(size.withColumnRenamed("cell", "c")), F.col("c") == F.col("b"))  # one row a cell
    pick = F.floor(uniform(F.lit("d"), F.col("id"), F.col("b")) * F.col("n")).cast("long")
    d = asked.select("id", "b", pick.alias("rank")).join(pool, ["b", "rank"]).groupBy("id").agg(F.count_distinct("drawn").alias("n"))
    return d.agg(F.count("*").alias("n_points"), F.round(F.avg("n"), 6).alias("diversity"))


@R.query(f"""WITH {HIST_SQL}, c AS (SELECT unnest(range(0, 110)) AS cell), d AS (SELECT c.cell, coalesce(arg_min(label, (-n, label)), 1000000) AS label FROM c LEFT JOIN h USING (cell) GROUP BY c.cell), k AS (SELECT cell, label, row_number() OVER (ORDER BY label, cell) - 1 AS k FROM d)
SELECT cell, CAST((k // 11) * 11 + CASE WHEN (k // 11) % 2 = 0 THEN k % 11 ELSE 10 - k % 11 END AS BIGINT) AS place FROM k""")
def oracle_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells dealt onto the grid by their commonest label, row by row to and fro; cells without points come last."""
    dominant = histogram(spark, sf_dir).groupBy("cell").agg(F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("label"))
    every = spark.range(CELLS).withColumnRenamed("id", "cell").join(dominant, "cell", "left").withColumn("one", F.lit(0))
    k = every.withColumn("k", F.row_number().over(W.partitionBy("one").orderBy(F.coalesce("label", F.lit(1_000_000)), "cell")) - 1)  # 110 rows
    row, col = F.floor(F.col("k") / WIDTH), F.col("k") % WIDTH
    return k.select("cell", (row * WIDTH + F.when(row % 2 == 0, col).otherwise(WIDTH - 1 - col)).cast("long").alias("place"))


@R.query(f"""WITH {CENTRE_SQL}, p AS (SELECT label, c, label * 11 % 110 AS cell FROM ce) SELECT count(*) AS n_pairs, round(sum(list_dot_product(a.c, b.c) * ({HOPS_SQL})), 5) AS cost FROM p a JOIN p b ON a.label <> b.label""")
def placement_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of regions times hops between their cells, over ordered pairs of regions (one row a region)."""
    p = centroids(spark, sf_dir).select("label", "c", (F.col("label") * 11 % CELLS).alias("cell"))
    a, b = (p.withColumnsRenamed({"label": f"l{x}", "c": f"c{x}", "cell": f"p{x}"}) for x in "ab")
    pairs = a.join(F.broadcast(b), F.col("la") != F.col("lb"))
    return pairs.agg(F.count("*").alias("n_pairs"), F.round(F.sum(V.dot(F.col("ca"), F.col("cb")) * V.hops(F.col("pa"), F.col("pb"), WIDTH, HEIGHT)), 5).alias("cost"))


@R.query(f"WITH {E_SQL} SELECT id, round(ln(id % 97 + 1), 6) AS log_count, round(norm, 6) AS norm FROM nrm")
def frequency_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a point's count and length alone say of it."""
    return points(spark, sf_dir).select("id", F.round(F.ln(F.col("id") % 97 + 1), 6).alias("log_count"), F.round(F.sqrt(V.dot(F.col("v"), F.col("v"))), 6).alias("norm"))


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, best, second, regret): each point's nearest region, and by how much the next one is worse."""
    c = F.broadcast(centroids(spark, sf_dir).select(F.col("label").alias("gate"), "c"))  # one row a region
    u = points(spark, sf_dir).select("id", V.unit(F.col("v")).alias("u"))
    sims = u.crossJoin(c).select("id", F.struct((-F.round(V.dot(F.col("u"), F.col("c")), 6)).alias("s"), "gate").alias("x"))
    top = sims.groupBy("id").agg(F.slice(F.array_sort(F.collect_list("x")), 1, 2).alias("x"))
    return top.select("id", F.get("x", F.lit(0))["gate"].alias("best"), F.get("x", F.lit(1))["gate"].alias("second"), F.round(F.get("x", F.lit(1))["s"] - F.get("x", F.lit(0))["s"], 6).alias("regret"))


@R.query(f"""WITH {CENTRE_SQL}, g AS (SELECT id, ce.label AS gate, round(list_dot_product(u, c), 6) AS s FROM u, ce), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, gate) AS k FROM g)
SELECT a.id, a.gate AS best, b.gate AS second, round(a.s - b.s, 6) AS regret FROM k a LEFT JOIN k b ON a.id = b.id AND b.k = 2 WHERE a.k = 1""")
def regrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in the order in which a balanced assignment serves them: the largest regret first."""
    return preferences(spark, sf_dir).orderBy(F.desc("regret"), "id")


AGREE_SQL = f"""{TURNS_SQL}, aw AS (SELECT conv_id, turn, regexp_extract_all(lower(prompt), '[a-z0-9'']+') AS p, regexp_extract_all(lower(completion), '[a-z0-9'']+') AS c FROM pairs),
ag AS (SELECT *, coalesce(list_position(list_transform(range(1, greatest(len(p), len(c)) + 2), lambda i: i <= least(len(p), len(c)) AND p[i] = c[i]), false), 1) - 1 AS n FROM aw)"""


def agreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = turn_pairs(spark, sf_dir).select("conv_id", "turn", T.words_of(F.col("prompt")).alias("p"), T.words_of(F.col("completion")).alias("c"))
    return w.withColumn("n", T.leading_agreement(F.col("p"), F.col("c")))


@R.query(f"WITH {AGREE_SQL} SELECT CAST(min(n) AS BIGINT) AS low, round(median(n), 6) AS middle, CAST(max(n) AS BIGINT) AS high, count(*) AS n FROM ag")
def agreement_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, median and greatest number of leading words that a turn shares with the one before."""
    return agreements(spark, sf_dir).agg(F.min("n").alias("low"), F.round(F.median("n"), 6).alias("middle"), F.max("n").alias("high"), F.count("*").alias("n"))


@R.query(f"""WITH {AGREE_SQL}, d AS (SELECT CASE WHEN p <> c THEN n END AS place FROM ag) SELECT count(*) AS n, count(place) AS n_changed, round(count(place) / greatest(count(*), 1), 4) AS fraction_changed, round(median(place), 6) AS median_first_divergence,
count(place) / greatest(count(*), 1) >= 0.5 AS load_bearing FROM d""")
def swap_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two answers differ, and where first in the median among those that do."""
    d = agreements(spark, sf_dir).select(F.when(F.col("p") != F.col("c"), F.col("n")).alias("at"))
    share = F.count("at") / F.greatest(F.count("*"), F.lit(1))
    return d.agg(F.count("*").alias("n"), F.count("at").alias("n_changed"), F.round(share, 4).alias("fraction_changed"), F.round(F.median("at"), 6).alias("median_first_divergence"), (share >= 0.5).alias("load_bearing"))


STREAM_SQL = f"""k AS (SELECT condition, core, i FROM (VALUES ('distinct'), ('identical')) t(condition), range(0, 6) c(core), range(0, 40) d(i)), u AS (SELECT *, CASE condition WHEN 'distinct' THEN {md5_uniform("'s-' || core || '-' || i")} ELSE {md5_uniform("'s-0-' || i")} END AS u FROM k)"""


@R.query(f"""WITH {STREAM_SQL}, l AS (SELECT condition, core, list(u ORDER BY i) AS l FROM u GROUP BY ALL), f AS (SELECT condition, l AS first FROM l WHERE core = 0),
s AS (SELECT condition, count(*) AS num_cores, count(*) FILTER (l = first) AS identical_to_first FROM l JOIN f USING (condition) GROUP BY condition), m AS (SELECT condition, bool_and(u >= 0 AND u < 1) AS in_unit_interval, round(avg(u), 6) AS mean, round(stddev_pop(u), 6) AS std FROM u GROUP BY condition)
SELECT condition, num_cores, identical_to_first, in_unit_interval, mean, std, CASE WHEN identical_to_first = num_cores THEN 'no core identity' ELSE 'core identity, reproducible' END AS verdict FROM s JOIN m USING (condition)""")
def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six cores' streams of 40 numbers, seeded each for itself or all alike, against the first core's."""
    cores = spark.range(6).withColumnRenamed("id", "core").crossJoin(F.broadcast(spark.range(40).withColumnRenamed("id", "i")))  # constants
    both = cores.withColumn("condition", F.explode(F.array(F.lit("distinct"), F.lit("identical"))))
    draws = both.withColumn("u", uniform(F.lit("s"), F.when(F.col("condition") == "distinct", F.col("core")).otherwise(0), F.col("i")))
    lists = draws.groupBy("condition", "core").agg(F.array_sort(F.collect_list(F.struct("i", "u"))).alias("l"))
    first = F.broadcast(lists.where("core = 0").select("condition", F.col("l").alias("first")))
    s = lists.join(first, "condition").groupBy("condition").agg(F.count("*").alias("num_cores"), F.count_if(F.col("l") == F.col("first")).alias("identical_to_first"))
    m = draws.groupBy("condition").agg(F.every((F.col("u") >= 0) & (F.col("u") < 1)).alias("in_unit_interval"), F.round(F.avg("u"), 6).alias("mean"), F.round(F.stddev_pop("u"), 6).alias("std"))
    verdict = F.when(F.col("identical_to_first") == F.col("num_cores"), "no core identity").otherwise("core identity, reproducible")
    return s.join(m, "condition").withColumn("verdict", verdict)


@R.query(f"""WITH {SIGNALS_SQL}, live AS (SELECT signal, abs(avg(d)) AS floor FROM d WHERE signal = 'n_chars' GROUP BY signal), snap AS (SELECT * FROM (VALUES ('n_chars', 9.5), ('n_words', 0.5)) t(signal, floor)), names AS (SELECT unnest(['n_chars', 'n_words', 'engagement']) AS signal)
SELECT signal, round(CAST(coalesce(live.floor, snap.floor) AS DOUBLE), 6) AS floor, CASE WHEN live.floor IS NOT NULL THEN 'derived' WHEN snap.floor IS NOT NULL THEN 'snapshot' ELSE 'none' END AS provenance FROM names LEFT JOIN live USING (signal) LEFT JOIN snap USING (signal)""")
def seed_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise floors: the size of a control's own difference, else the snapshot's, else none, with where it is from."""
    live = signal_deltas(spark, sf_dir).where("signal = 'n_chars'").groupBy("signal").agg(F.abs(F.avg("d")).alias("live"))
    snap = spark.createDataFrame([("n_chars", 9.5), ("n_words", 0.5)], "signal string, snap double")
    names = spark.createDataFrame([("n_chars",), ("n_words",), ("engagement",)], "signal string")
    joined = names.join(live, "signal", "left").join(F.broadcast(snap), "signal", "left")  # constants
    where = F.when(F.col("live").isNotNull(), "derived").when(F.col("snap").isNotNull(), "snapshot").otherwise("none")
    return joined.select("signal", F.round(F.coalesce("live", "snap"), 6).alias("floor"), where.alias("provenance"))


@R.query(f"""WITH {PAIR_SQL}, m AS (SELECT count(*) AS n, avg(delta) AS mean, stddev_samp(delta) AS sd, stddev_samp(delta) / sqrt(count(*)) AS se, count(*) FILTER (delta < 0) AS down, count(*) FILTER (delta > 0) AS up FROM p)
SELECT n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(se, 6) AS se, CASE WHEN mean < 0 THEN down ELSE up END AS agree, CASE WHEN n < 3 THEN 'too few steps' WHEN se = 0 AND mean = 0 THEN 'identical' WHEN se <> 0 AND abs(mean) <= 2 * se THEN 'not interpretable' WHEN mean < 0 THEN 'better' ELSE 'worse' END AS verdict FROM m""")
def run_verdict_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of one seed: the mean difference against two of its standard errors, with how many signs agree."""
    d = F.col("delta")
    m = deltas(spark, sf_dir).agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"), (F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("se"), F.count_if(d < 0).alias("down"), F.count_if(d > 0).alias("up"))
    mean, se = F.col("mean"), F.col("se")
    verdict = F.when(F.col("n") < 3, "too few steps").when((se == 0) & (mean == 0), "identical").when((se != 0) & (F.abs(mean) <= 2 * se), "not interpretable").when(mean < 0, "better").otherwise("worse")
    return m.select("n", *[F.round(x, 6).alias(x) for x in ("mean", "sd", "se")], F.when(mean < 0, F.col("down")).otherwise(F.col("up")).alias("agree"), verdict.alias("verdict"))


@R.query("""WITH l AS (SELECT 'src' || user_id % 20 AS source, value FROM events), s AS (SELECT source, count(*) AS n, avg(value) AS mean, stddev_samp(value) / sqrt(count(*)) AS sem FROM l GROUP BY source), f AS (SELECT source, CAST(substr(source, 4) AS INTEGER) % 4 AS k, n, mean, sem FROM s)
SELECT source, n, CASE WHEN n >= 20 THEN round(mean, 6) END AS loss, CASE WHEN n >= 20 THEN round(sem, 6) END AS sem, CASE WHEN k = 0 THEN 'none' WHEN k = 1 THEN 'split' ELSE 'unseen tail' END AS held_out, CASE WHEN n < 20 THEN 'too few windows: ' || n WHEN k = 0 THEN 'a whole pass was seen' ELSE '' END AS note FROM f""")
def source_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of each source with where its held-out text is from; too few windows give a note, not a number."""
    l = table(spark, sf_dir, "events").select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source"), "value")
    s = l.groupBy("source").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), (F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("sem"))
    k, enough = F.substring("source", 4, 9).cast("int") % 4, F.col("n") >= 20
    held = F.when(k == 0, "none").when(k == 1, "split").otherwise("unseen tail")
    note = F.when(~enough, F.concat(F.lit("too few windows: "), F.col("n").cast("string"))).when(k == 0, "a whole pass was seen").otherwise("")
    return s.select("source", "n", F.when(enough, F.round("mean", 6)).alias("loss"), F.when(enough, F.round("sem", 6)).alias("sem"), held.alias("held_out"), note.alias("note"))


def window_problem(asked: Column, capacity: Column, other: Column) -> Column:
    """Why two models cannot be compared at a window, null if they can."""
    return F.when(asked > capacity, "the window is longer than the context").when(asked != other, "the windows differ")


@R.query("SELECT p_partkey, CASE WHEN p_size * 16 > 512 THEN 'the window is longer than the context' WHEN p_size * 16 <> 256 THEN 'the windows differ' END AS problem FROM part")
def window_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", window_problem(F.col("p_size") * 16, F.lit(512), F.lit(256)).alias("problem"))


@R.query(f"""WITH {HIST_SQL}, t AS (SELECT cell, sum(n) AS t FROM h GROUP BY cell), p AS (SELECT label, sum(n * (n - 1)) / nullif(sum(n * (t - 1)), 0) AS purity, sum(n) / (SELECT count(*) FROM embeddings) AS chance FROM h JOIN t USING (cell) GROUP BY label)
SELECT label, round(purity, 6) AS purity, round((purity - chance) / (1 - chance), 6) AS retention, CASE WHEN (purity - chance) / (1 - chance) >= 0.5 THEN 'SURVIVES' ELSE 'COLLAPSED' END AS verdict FROM p""")
def headroom_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the room above chance each label's cells keep, and whether that is half of it or more."""
    h = histogram(spark, sf_dir)
    t = h.groupBy("cell").agg(F.sum("n").alias("t"))
    p = h.join(F.broadcast(t), "cell").groupBy("label").agg(F.try_divide(F.sum(F.col("n") * (F.col("n") - 1)), F.sum(F.col("n") * (F.col("t") - 1))).alias("purity"), F.sum("n").alias("own"))  # one row a cell
    room = p.crossJoin(F.broadcast(h.agg(F.sum("n").alias("all")))).withColumn("chance", F.col("own") / F.col("all"))
    kept = S.retention(F.col("purity"), F.col("chance"), F.lit(1.0), F.col("chance"))
    return room.select("label", F.round("purity", 6).alias("purity"), F.round(kept, 6).alias("retention"), F.when(kept >= 0.5, "SURVIVES").otherwise("COLLAPSED").alias("verdict"))


@R.query(f"""WITH {TURNS_SQL}, s AS (SELECT conv_id, {MARKERS_SQL.format(t='completion')} AS m, regexp_extract_all(lower(completion), '[a-z0-9'']+') AS w, list_distinct({P_SQL}) AS p, {C_SQL} AS c, suffix(rtrim(completion), '.') AS ended FROM pairs),
x AS (SELECT conv_id, CASE WHEN len(m) > 0 THEN 1.0 ELSE 0.0 END AS collapsed, CASE WHEN list_has_any(m, {quoted(T.FRAME_MARKERS)}) THEN 1.0 ELSE 0.0 END AS frame, CASE WHEN ended THEN 1.0 ELSE 0.0 END AS ended, CAST(len(w) AS DOUBLE) AS n_tokens,
 CASE WHEN len(w) >= 4 THEN 1 - len(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) / (len(w) - 3) END AS repeat_rate, CASE WHEN len(p) > 0 THEN len(list_intersect(p, c)) / len(p) END AS engagement FROM s)
SELECT conv_id, count(*) AS n, round(avg(collapsed), 6) AS collapse_rate, round(avg(frame), 6) AS frame_collapse_rate, round(avg(ended), 6) AS termination_rate, round(avg(repeat_rate), 6) AS repeat_rate, round(avg(engagement), 6) AS engagement, round(avg(n_tokens), 6) AS n_tokens,
 round(coalesce(stddev_samp(n_tokens) / sqrt(count(n_tokens)), 0), 6) AS n_tokens_sem FROM x GROUP BY conv_id""")
def prompt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's completions: means of the signals of every one, and the standard error of their length."""
    c, p = F.col("completion"), F.col("prompt")
    m = turn_pairs(spark, sf_dir).select("conv_id", T.markers_found(c).alias("m"), T.words_of(c).alias("w"), T.engagement(p, c).alias("engagement"), F.rtrim(c).endswith(".").alias("ended"))
    x = m.select("conv_id", (F.size("m") > 0).cast("double").alias("collapsed"), T.frame_collapsed(F.col("m")).cast("double").alias("frame"), F.col("ended").cast("double").alias("ended"), F.size("w").cast("double").alias("n_tokens"), T.repeat_rate(F.col("w")).alias("repeat_rate"), "engagement")
    mean = lambda a, b: F.round(F.avg(a), 6).alias(b)
    return x.groupBy("conv_id").agg(
        F.count("*").alias("n"), mean("collapsed", "collapse_rate"), mean("frame", "frame_collapse_rate"), mean("ended", "termination_rate"), mean("repeat_rate", "repeat_rate"), mean("engagement", "engagement"), mean("n_tokens", "n_tokens"),
        F.round(S.sem(F.col("n_tokens")), 6).alias("n_tokens_sem"),
    )


QUERIES, ORACLE = R.queries, R.oracle
