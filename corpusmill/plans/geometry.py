"""Queries over embeddings, grid layouts, cell reductions and sampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.operators import vectors as V
from corpusmill.operators.prefix import running_total
from corpusmill.plans.base import Registry, table

R = Registry()
K, WIDTH, HEIGHT = 10, 11, 10
CELLS = WIDTH * HEIGHT
E_SQL = "e AS (SELECT vec_id AS id, label, vec_id % 110 AS cell, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), nrm AS (SELECT *, sqrt(list_dot_product(v, v)) AS norm FROM e), u AS (SELECT id, label, cell, v, list_transform(v, lambda x: x / greatest(norm, 1e-12)) AS u FROM nrm)"
NEAR_SQL = f"{E_SQL}, sm AS (SELECT a.id, a.label, b.id AS neighbour, b.label AS nl, round(list_dot_product(a.u, b.u), 9) AS sim FROM u a JOIN u b ON a.id <> b.id), nb AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, neighbour) AS rank FROM sm QUALIFY rank <= {K})"
HOPS_SQL = "least(abs(a.cell % 11 - b.cell % 11), 11 - abs(a.cell % 11 - b.cell % 11)) + least(abs(a.cell // 11 - b.cell // 11), 10 - abs(a.cell // 11 - b.cell // 11))"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", (F.col("vec_id") % CELLS).alias("cell"), F.col("embedding").cast("array<double>").alias("v"))


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return V.neighbours(p, p.select("id", "v"), K)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("id", "label")
    return graph(spark, sf_dir).join(p, "id").join(p.withColumnsRenamed({"id": "neighbour", "label": "nl"}), "neighbour")


@R.query(f"WITH {NEAR_SQL} SELECT id, neighbour, rank, round(sim, 6) AS sim FROM nb")
def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).select("id", "neighbour", F.col("rank").cast("long").alias("rank"), F.round("sim", 6).alias("sim"))


@R.query(f"WITH {NEAR_SQL} SELECT label, count(*) AS n, round(avg(CASE WHEN label = nl THEN 1.0 ELSE 0.0 END), 6) AS purity FROM nb GROUP BY label")
def knn_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("nl")).cast("int")), 6).alias("purity"))


@R.query(f"WITH {NEAR_SQL} SELECT label, nl, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS share FROM nb GROUP BY label, nl")
def knn_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = labelled(spark, sf_dir).groupBy("label", "nl").agg(F.count("*").alias("n"))
    return c.select("label", "nl", F.round(F.col("n") / F.sum("n").over(W.partitionBy("label")), 6).alias("share"))


@R.query(f"""WITH {NEAR_SQL}, tr AS (SELECT unnest(range(0, 5)) AS trial), rk AS (SELECT trial, id, row_number() OVER (PARTITION BY trial ORDER BY md5(trial || '-' || id), id) AS k FROM e, tr), os AS (SELECT id, label, row_number() OVER (ORDER BY id) AS k FROM e),
pl AS (SELECT trial, rk.id, os.label FROM rk JOIN os USING (k)), pu AS (SELECT a.trial, avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END) AS p FROM nb JOIN pl a ON a.id = nb.id JOIN pl b ON b.id = nb.neighbour AND a.trial = b.trial GROUP BY a.trial)
SELECT round(avg(p), 6) AS mean, round(stddev_samp(p), 6) AS sd, count(*) AS n FROM pu""")
def perm_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purity of the same neighbour graph under five hash-ordered label permutations."""
    p = points(spark, sf_dir).select("id", "label")
    trials = p.select("id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("trial"))
    # The order of the first 60 bits of a hash; ranks are running counts, so no trial meets in one task.
    turn = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("trial").cast("string"), F.col("id").cast("string"))), 1, 15), 16, 10).cast("long")
    by_hash = running_total(trials.withColumn("turn", turn), ["trial"], "turn", F.lit(1), "k").select("trial", "id", "k")
    by_id = running_total(p.withColumn("one", F.lit(0)), ["one"], "id", F.lit(1), "k").select("k", "label")
    shuffled = by_hash.join(by_id, "k").select("trial", "id", "label")
    near = graph(spark, sf_dir).select("id", "neighbour")
    pairs = near.join(shuffled, "id").join(shuffled.withColumnsRenamed({"id": "neighbour", "label": "nl"}), ["neighbour", "trial"])
    each = pairs.groupBy("trial").agg(F.avg((F.col("label") == F.col("nl")).cast("int")).alias("p"))
    return each.agg(F.round(F.avg("p"), 6).alias("mean"), F.round(F.stddev_samp("p"), 6).alias("sd"), F.count("*").alias("n"))


@R.query(f"WITH {E_SQL} SELECT id, round(list_sum(u), 6) AS total, round(list_dot_product(u, u), 6) AS square FROM u")
def unit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = points(spark, sf_dir).select("id", V.unit(F.col("v")).alias("u"))
    return u.select("id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(V.dot(F.col("u"), F.col("u")), 6).alias("square"))


@R.query(f"""WITH {E_SQL}, m AS (SELECT a.id, a.label, b.label AS other, avg(1 - list_dot_product(a.u, b.u)) AS d FROM u a JOIN u b ON a.id <> b.id GROUP BY ALL),
s AS (SELECT id, label, max(d) FILTER (label = other) AS a, min(d) FILTER (label <> other) AS b FROM m GROUP BY ALL)
SELECT label, round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM s GROUP BY label""")
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine silhouette; mean distances to a class come from the sum of its vectors, so no pairs are formed."""
    u = points(spark, sf_dir).select("id", "label", V.unit(F.col("v")).alias("u"))
    # One row a class.
    sums = F.broadcast(V.vector_sums(u, "label").select(F.col("label").alias("other"), "n", "total"))
    own = F.col("label") == F.col("other")
    s = V.dot(F.col("u"), F.col("total"))
    self_ = V.dot(F.col("u"), F.col("u"))
    d = F.when(own, F.try_divide(F.col("n") - 1 - (s - self_), F.col("n") - 1)).otherwise(1 - s / F.col("n"))
    each = u.crossJoin(sums).withColumn("d", d).groupBy("id", "label").agg(F.max(F.when(own, F.col("d"))).alias("a"), F.min(F.when(~own, F.col("d"))).alias("b"))
    value = F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b"), F.lit(0.0))
    return each.groupBy("label").agg(F.round(F.avg(value), 6).alias("silhouette"))


@R.query(f"WITH c AS (SELECT unnest(range(0, 110)) AS cell) SELECT {HOPS_SQL} AS hops, count(*) AS n FROM c a, c b GROUP BY 1")
def grid_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of the 11 x 10 torus are how far apart (110 cells: a constant)."""
    a, b = spark.range(CELLS).withColumnRenamed("id", "a"), spark.range(CELLS).withColumnRenamed("id", "b")
    return a.crossJoin(F.broadcast(b)).groupBy(V.hops(F.col("a"), F.col("b"), WIDTH, HEIGHT).alias("hops")).agg(F.count("*").alias("n"))


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, label, n): at most cells x labels rows, whatever the number of points."""
    return points(spark, sf_dir).groupBy("cell", "label").agg(F.count("*").alias("n"))


@R.query(f"WITH {E_SQL}, h AS (SELECT cell, label, count(*) AS n FROM e GROUP BY ALL), c AS (SELECT cell, sum(n) AS t, sum(n * (n - 1)) AS s FROM h GROUP BY cell) SELECT CAST(sum(t * (t - 1)) AS BIGINT) AS n_pairs, round(sum(s) / sum(t * (t - 1)), 6) AS purity, round((SELECT sum(p * p) FROM (SELECT count(*) / (SELECT count(*) FROM e) AS p FROM e GROUP BY label)), 6) AS chance FROM c")
def within_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = histogram(spark, sf_dir)
    cells = h.groupBy("cell").agg(F.sum("n").alias("t"), F.sum(F.col("n") * (F.col("n") - 1)).alias("s"))
    by_label = h.groupBy("label").agg(F.sum("n").alias("n"))
    chance = by_label.agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("chance"))
    pairs = F.sum(F.col("t") * (F.col("t") - 1))
    return cells.agg(pairs.alias("n_pairs"), F.round(F.sum("s") / pairs, 6).alias("purity")).crossJoin(F.broadcast(chance)).withColumn("chance", F.round("chance", 6))


@R.query(f"WITH {E_SQL} SELECT hops, count(*) AS n_pairs, round(avg(CASE WHEN la = lb THEN 1.0 ELSE 0.0 END), 6) AS purity FROM (SELECT {HOPS_SQL} AS hops, a.label AS la, b.label AS lb FROM e a JOIN e b ON a.id <> b.id) WHERE hops <= 5 GROUP BY hops")
def purity_by_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of equal labels among points how many hops apart, from the cells' histograms."""
    h = histogram(spark, sf_dir)
    cells = h.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("m"), F.sum("n").alias("t"))
    a, b = (cells.select(F.col("cell").alias(f"c{x}"), F.col("m").alias(f"m{x}"), F.col("t").alias(f"t{x}")) for x in "ab")
    pairs = a.crossJoin(F.broadcast(b)).withColumn("hops", V.hops(F.col("ca"), F.col("cb"), WIDTH, HEIGHT)).where("hops <= 5")
    same = F.aggregate(F.map_keys("ma"), F.lit(0).cast("long"), lambda s, k: s + F.element_at("ma", k) * F.coalesce(F.try_element_at("mb", k), F.lit(0)))
    self_ = F.when(F.col("ca") == F.col("cb"), F.col("ta")).otherwise(0)
    n = F.sum(F.col("ta") * F.col("tb") - self_)
    return pairs.groupBy("hops").agg(n.alias("n_pairs"), F.round(F.try_divide(F.sum(same - self_), n), 6).alias("purity")).where("n_pairs > 0")


@R.query(f"WITH {E_SQL} SELECT a.label, round(avg({HOPS_SQL}), 6) AS mean_hops FROM e a JOIN e b ON a.label = b.label AND a.id < b.id GROUP BY a.label")
def pairwise_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = histogram(spark, sf_dir)
    a, b = h.withColumnsRenamed({"cell": "ca", "n": "na"}), h.withColumnsRenamed({"cell": "cb", "n": "nb"})
    pairs = a.join(b, "label").groupBy("label").agg(F.sum(F.col("na") * F.col("nb") * V.hops(F.col("ca"), F.col("cb"), WIDTH, HEIGHT)).alias("s"))
    n = h.groupBy("label").agg(F.sum("n").alias("n"))
    return pairs.join(n, "label").select("label", F.round(F.coalesce(F.try_divide(F.col("s"), F.col("n") * (F.col("n") - 1)), F.lit(0.0)), 6).alias("mean_hops"))


@R.query(f"WITH {E_SQL}, c AS (SELECT unnest(range(0, 110)) AS cell), t AS (SELECT b.label, a.cell, sum({HOPS_SQL}) AS total FROM c a, e b GROUP BY ALL) SELECT label, arg_min(cell, (total, cell)) AS cell, CAST(min(total) AS BIGINT) AS total FROM t GROUP BY label")
def medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cell from which a label's points are fewest hops away, the lowest among equals."""
    cand = F.broadcast(spark.range(CELLS).withColumnRenamed("id", "cand"))
    total = histogram(spark, sf_dir).crossJoin(cand).groupBy("label", "cand").agg(F.sum(F.col("n") * V.hops(F.col("cand"), F.col("cell"), WIDTH, HEIGHT)).alias("total"))
    best = total.groupBy("label").agg(F.min(F.struct("total", "cand")).alias("m"))
    return best.select("label", F.col("m.cand").alias("cell"), F.col("m.total").alias("total"))


@R.query("WITH p AS (SELECT label, count(*) / (SELECT count(*) FROM embeddings) AS p FROM embeddings GROUP BY label) SELECT n, round(sum(1 - pow(1 - p, n)), 6) AS expected FROM p, (SELECT unnest(range(1, 13)) AS n) GROUP BY n")
def expected_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = points(spark, sf_dir).groupBy("label").agg(F.count("*").alias("c"))
    p = c.crossJoin(F.broadcast(c.agg(F.sum("c").alias("t")))).select((F.col("c") / F.col("t")).alias("p"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(12).cast("long"))).alias("n"))
    return p.groupBy("n").agg(F.round(F.sum(1 - F.pow(1 - F.col("p"), F.col("n"))), 6).alias("expected"))


@R.query(f"WITH c AS (SELECT unnest(range(0, 110)) AS cell), s AS (SELECT unnest([0, 17, 38, 59, 80, 104]) AS cell), d AS (SELECT a.cell, b.cell AS seed, {HOPS_SQL} AS h FROM c a, s b) SELECT seed, count(*) AS n_cells, CAST(sum(h) AS BIGINT) AS total FROM (SELECT cell, arg_min(seed, (h, seed)) AS seed, min(h) AS h FROM d GROUP BY cell) GROUP BY seed")
def voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells to their nearest seed, the lowest among equals."""
    seeds = F.broadcast(spark.createDataFrame([(x,) for x in (0, 17, 38, 59, 80, 104)], "seed int"))
    d = spark.range(CELLS).crossJoin(seeds).withColumn("h", V.hops(F.col("id"), F.col("seed"), WIDTH, HEIGHT))
    best = d.groupBy("id").agg(F.min(F.struct("h", "seed")).alias("m"))
    return best.groupBy(F.col("m.seed").alias("seed")).agg(F.count("*").alias("n_cells"), F.sum("m.h").alias("total"))


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = points(spark, sf_dir).select("label", V.unit(F.col("v")).alias("u"))
    return V.vector_sums(u, "label").select("label", V.unit(F.col("total")).alias("c"), "n")


CENTRE_SQL = f"{E_SQL}, pe AS (SELECT label, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM u), ps AS (SELECT label, i, sum(x) AS x FROM pe GROUP BY ALL), cs AS (SELECT label, list(x ORDER BY i) AS s FROM ps GROUP BY label), ce AS (SELECT label, list_transform(s, lambda x: x / sqrt(list_dot_product(s, s))) AS c FROM cs)"


@R.query(f"WITH {CENTRE_SQL} SELECT label, round(list_sum(c), 6) AS total, round(c[1], 6) AS first FROM ce")
def region_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids(spark, sf_dir).select("label", F.round(F.aggregate("c", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.get("c", F.lit(0)), 6).alias("first"))


@R.query(f"WITH {CENTRE_SQL}, g AS (SELECT id, u.label, arg_min(ce.label, (-round(list_dot_product(u, c), 9), ce.label)) AS got FROM u, ce GROUP BY ALL) SELECT label, count(*) AS n, round(avg(CASE WHEN label = got THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM g GROUP BY label")
def gate_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a point's nearest region centroid is its own (one row a region is broadcast)."""
    c = F.broadcast(centroids(spark, sf_dir).select(F.col("label").alias("gate"), "c"))
    u = points(spark, sf_dir).select("id", "label", V.unit(F.col("v")).alias("u"))
    best = u.crossJoin(c).groupBy("id", "label").agg(F.min(F.struct((-F.round(V.dot(F.col("u"), F.col("c")), 9)).alias("s"), "gate")).alias("m"))
    return best.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("m.gate") == F.col("label")).cast("int")), 6).alias("accuracy"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, cell, x): the first element of each vector as a logit."""
    return points(spark, sf_dir).select("id", "cell", F.round(F.get("v", F.lit(0)), 3).alias("x"))


L_SQL = "l AS (SELECT vec_id AS id, vec_id % 110 AS cell, round(CAST(embedding[1] AS DOUBLE), 3) AS x FROM embeddings)"


@R.query(f"WITH {L_SQL} SELECT cell, max(x) AS best, min(id) FILTER (x = mx) AS first_id, max(id) FILTER (x = mx) AS last_id FROM (SELECT *, max(x) OVER (PARTITION BY cell) AS mx FROM l) GROUP BY cell")
def cell_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest logit of each cell with its first and its last holder."""
    return logits(spark, sf_dir).groupBy("cell").agg(F.max("x").alias("best"), F.max_by("id", F.struct("x", -F.col("id"))).alias("first_id"), F.max_by("id", F.struct("x", "id")).alias("last_id"))


@R.query(f"WITH {L_SQL} SELECT c.cell, max(x) AS best FROM (SELECT unnest(range(0, 112)) AS cell) c LEFT JOIN l USING (cell) GROUP BY c.cell")
def cell_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest logit of every cell; null for one without points."""
    cells = spark.range(112).withColumnRenamed("id", "cell")
    return cells.join(logits(spark, sf_dir).groupBy("cell").agg(F.max("x").alias("best")), "cell", "left")


def log_sum_exp(df: DataFrame) -> DataFrame:
    """(cell, lse), stable: the cell's largest logit is taken out first."""
    top = df.groupBy("cell").agg(F.max("x").alias("m"))
    return df.join(top, "cell").groupBy("cell").agg((F.max("m") + F.ln(F.sum(F.exp(F.col("x") - F.col("m"))))).alias("lse"))


@R.query(f"WITH {L_SQL}, c AS (SELECT cell, ln(sum(exp(x))) AS lse FROM l GROUP BY cell) SELECT cell, round(lse, 6) AS lse, round(exp(lse) / sum(exp(lse)) OVER (), 6) AS p FROM c")
def cell_lse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = log_sum_exp(logits(spark, sf_dir))  # one row a cell
    top = F.broadcast(log_sum_exp(c.select(F.lit(0).alias("cell"), F.col("lse").alias("x"))).select(F.col("lse").alias("all")))
    return c.crossJoin(top).select("cell", F.round("lse", 6).alias("lse"), F.round(F.exp(F.col("lse") - F.col("all")), 6).alias("p"))


def hashed_uniform(key: Column) -> Column:
    """A number between 0 and 1 from the first 32 bits of a hash that every engine has."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


@R.query(f"WITH {L_SQL}, g AS (SELECT id, cell, x - ln(-ln((CAST('0x' || substr(md5('g' || id), 1, 8) AS BIGINT) + 0.5) / 4294967296.0)) AS s FROM l) SELECT cell, arg_max(id, s) AS drawn FROM g GROUP BY cell")
def gumbel_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One draw from each cell's softmax: the largest of logits with Gumbel noise."""
    noise = -F.ln(-F.ln(hashed_uniform(F.concat(F.lit("g"), F.col("id").cast("string")))))
    return logits(spark, sf_dir).withColumn("s", F.col("x") + noise).groupBy("cell").agg(F.max_by("id", "s").alias("drawn"))


@R.query()
def pca_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates on the two main axes, from a Gram matrix summed over all rows; signs by the largest weight."""
    p = points(spark, sf_dir)
    one = p.select("v").first()
    if one is None:
        return p.select("id", F.lit(None).cast("double").alias("pc1"), F.lit(None).cast("double").alias("pc2"))
    n, total, products = V.gram(p, len(one["v"]))
    mean = total / n
    _, axes = np.linalg.eigh(products / n - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :2]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(2)])
    shift = mean @ axes
    cols = [F.round(V.dot(F.col("v"), F.array(*[F.lit(float(x)) for x in axes[:, k]])) - float(shift[k]), 6).alias(f"pc{k + 1}") for k in range(2)]
    return p.select("id", *cols)


@R.query()
def derangement_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a relabelling without fixed points lifts as much as the true labels: (ge + 1) / (N + 1)."""
    labels = F.broadcast(points(spark, sf_dir).select("label").distinct())
    trials = spark.range(400).withColumnRenamed("id", "trial").crossJoin(labels)
    order = W.partitionBy("trial").orderBy(F.md5(F.concat_ws("-", F.col("trial").cast("string"), F.col("label").cast("string"))))
    k = trials.withColumn("k", F.row_number().over(order)).join(trials.withColumn("k", F.row_number().over(W.partitionBy("trial").orderBy("label"))).select("trial", "k", F.col("label").alias("to")), ["trial", "k"])
    free = k.groupBy("trial").agg(F.collect_list(F.struct("label", "to")).alias("moves"), F.count_if(F.col("label") == F.col("to")).alias("fixed")).where("fixed = 0")
    share = points(spark, sf_dir).withColumn("q", F.col("cell") % 10).groupBy("q", "label").agg(F.count("*").alias("n"))
    key = (F.col("q") * 1000 + F.col("label")).alias("k")
    cells = F.broadcast(share.agg(F.map_from_entries(F.collect_list(F.struct(key, F.col("n").alias("v")))).alias("m")))
    null = free.crossJoin(cells).select("trial", F.aggregate("moves", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.try_element_at("m", x["label"].cast("bigint") * 1000 + x["to"]), F.lit(0))).alias("v"))
    observed = points(spark, sf_dir).where(F.col("cell") % 10 == F.col("label")).agg(F.count("*").alias("obs"))
    return null.crossJoin(F.broadcast(observed)).agg(F.count("*").alias("n"), ((F.count_if(F.col("v") >= F.col("obs")) + 1) / (F.count("*") + 1)).alias("p"))


QUERIES, ORACLE = R.queries, R.oracle
