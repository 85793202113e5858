"""Queries over sources, registries, token arrays, manifests and arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import stats as S
from corpusmill.functions import text as T
from corpusmill.operators import compose as C
from corpusmill.operators.prefix import running_total
from corpusmill.operators.shared import small
from corpusmill.plans.base import Registry, table
from corpusmill.plans.composition import AVAIL_SQL, BUDGET, NW, REG_SQL, SELECTORS, counted, reg
from corpusmill.plans.texts import documents

R = Registry()
WS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\t-\\r ]+'), lambda x: x <> '')"
FIRST, EOS = 500, 2


@R.query(f"""WITH w AS (SELECT source, doc_id, {WS} AS ws FROM documents),
c AS (SELECT *, CAST(sum(len(ws)) OVER (PARTITION BY source ORDER BY doc_id) - len(ws) AS BIGINT) AS ahead FROM w)
SELECT source, doc_id, CAST(least(len(ws), {FIRST} - ahead) AS BIGINT) AS n_taken, md5(array_to_string(ws[1:{FIRST} - ahead], ' ')) AS digest FROM c WHERE ahead < {FIRST} AND len(ws) > 0""")
def first_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 words of each source as they stand (a feature: the number asked for)."""
    w = documents(spark, sf_dir).select("source", "doc_id", T.split_words(F.col("text")).alias("ws"))
    ahead = running_total(w, ["source"], "doc_id", F.size("ws"), "ahead").where((F.col("ahead") < FIRST) & (F.size("ws") > 0))
    n = F.least(F.size("ws"), F.lit(FIRST) - F.col("ahead")).cast("int")
    return ahead.select("source", "doc_id", n.cast("long").alias("n_taken"), F.md5(F.array_join(F.slice("ws", F.lit(1), n), " ")).alias("digest"))


@R.query(f"""WITH w AS (SELECT source, doc_id, {NW} AS n FROM documents), c AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY doc_id) - n AS ahead FROM w)
SELECT source, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words FROM c WHERE ahead < 2500 GROUP BY source""")
def budget_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents of each source until 2,500 words are reached; the last may run over."""
    c = running_total(counted(spark, sf_dir), ["source"], "doc_id", F.col("n_words"), "ahead").where("ahead < 2500")
    return c.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"))


@R.query(f"SELECT source, CAST(sum(n) + count(*) AS BIGINT) AS n_tokens, count(*) AS n_eos, CAST(4 * (sum(n) + count(*)) AS BIGINT) AS n_bytes FROM (SELECT source, {NW} AS n FROM documents) GROUP BY source")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, end marks and bytes of each source's token array (a word's length plus 3, an end mark a document)."""
    ids = F.concat(F.transform(T.split_words(F.col("text")), lambda w: F.length(w) + 3), F.array(F.lit(EOS)))
    arrays = documents(spark, sf_dir).select("source", ids.alias("ids"))
    n, eos = F.sum(F.size("ids").cast("long")), F.sum(F.size(F.filter("ids", lambda x: x == EOS)).cast("long"))
    return arrays.groupBy("source").agg(n.alias("n_tokens"), eos.alias("n_eos"), (4 * n).alias("n_bytes"))


@R.query("""WITH sel AS (SELECT * FROM (VALUES ('steel', 'green', 'steel'), ('copper', NULL, 'copper'), ('red', 'red', NULL), ('none', NULL, NULL)) t(name, a, b))
SELECT name, count(p_partkey) AS n, count(p_partkey) = 0 AS no_match FROM sel LEFT JOIN part ON coalesce(contains(lower(p_name), a), false) OR coalesce(contains(lower(p_type), b), false) GROUP BY name""")
def catalogue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of every registered selector, zero counts too."""
    sel = spark.createDataFrame(SELECTORS, "name string, authors array<string>, shelves array<string>")
    hit = C.matches(F.col("p_name"), F.col("p_type"), F.col("authors"), F.col("shelves"))
    counts = table(spark, sf_dir, "part").join(F.broadcast(sel), hit).groupBy("name").agg(F.count("*").alias("n"))  # a constant of four rows
    n = F.coalesce("n", F.lit(0).cast("long"))
    return sel.select("name").join(counts, "name", "left").select("name", n.alias("n"), (n == 0).alias("no_match"))


@R.query(f"""WITH {REG_SQL}, {AVAIL_SQL} SELECT '| ' || name || ' | ' || regexp_replace(printf('%.3f', share * 100), '\\.?0+$', '') || '% | ' || coalesce(CAST(words AS VARCHAR), 'missing') || ' | ' || CASE WHEN share_alike THEN 'yes' ELSE 'no' END || ' |' AS line
FROM reg LEFT JOIN avail ON name = source""")
def share_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the corpus card's table: source, share, words at hand, share-alike."""
    joined = reg(spark).join(C.availability(documents(spark, sf_dir)), F.col("name") == F.col("source"), "left")
    cells = [F.col("name"), C.format_share(F.col("target_share")), F.coalesce(F.col("words").cast("string"), F.lit("missing")), F.when(F.col("share_alike"), "yes").otherwise("no")]
    return joined.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


@R.query("SELECT min(n_regionkey) AS revision, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def one_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of one repository, which must share one revision; else an error."""
    mine = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    one = mine.agg(F.count_distinct("n_regionkey").alias("d"), F.min("n_regionkey").alias("revision"), F.count("*").alias("n"))
    return one.select(F.when(F.col("d") == 1, F.col("revision")).otherwise(F.raise_error(F.lit("not one revision")).cast("int")).alias("revision"), "n")


@R.query("SELECT p_partkey, coalesce(nullif(substr(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), 1, 40), ''), 'prompt') AS slug FROM part")
def part_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = F.substring(F.trim(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "-"), F.lit("-")), 1, 40)
    return table(spark, sf_dir, "part").select("p_partkey", F.when(slug == "", "prompt").otherwise(slug).alias("slug"))


@R.query(f"WITH w AS (SELECT source, doc_id, {NW} AS n FROM documents) SELECT source, doc_id, CAST(sum(n + 1) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS metered FROM w")
def token_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens written of each source after every document, its separator included."""
    w = counted(spark, sf_dir)
    ahead = running_total(w, ["source"], "doc_id", F.col("n_words") + 1, "ahead")
    return ahead.select("source", "doc_id", (F.col("ahead") + F.col("n_words") + 1).alias("metered"))


@R.query(f"""WITH {AVAIL_SQL}, t AS (SELECT source, sum(n) + count(*) AS tokenized FROM w GROUP BY source) SELECT source, tokens AS manifest, CAST(tokenized AS BIGINT) AS tokenized, CAST(abs(tokens - tokenized) AS BIGINT) AS gap,
round(abs(tokens - tokenized) / tokens * 100, 6) AS gap_percent FROM avail JOIN t USING (source) WHERE tokens > 0""")
def tokenized_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a manifest says against what was tokenised, in percent of the manifest."""
    by = counted(spark, sf_dir).groupBy("source").agg(F.floor(F.sum("n_words") * C.TOKENS_PER_WORD).cast("long").alias("manifest"), (F.sum("n_words") + F.count("*")).alias("tokenized"))
    gap = F.abs(F.col("manifest") - F.col("tokenized"))
    return by.where("manifest > 0").select("source", "manifest", "tokenized", gap.alias("gap"), F.round(gap / F.col("manifest") * 100, 6).alias("gap_percent"))


WORDS_SQL = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+')"


@R.query(f"""WITH w AS (SELECT doc_id, unnest({WORDS_SQL}) AS w, generate_subscripts({WORDS_SQL}, 1) AS i FROM documents), v AS (SELECT w, row_number() OVER (ORDER BY n DESC, w) + 3 AS id FROM (SELECT w, count(*) AS n FROM w GROUP BY w) ORDER BY 2 LIMIT 1000)
SELECT doc_id, count(*) AS n_ids, md5(string_agg(coalesce(id, 3), ' ' ORDER BY i)) AS ids FROM w LEFT JOIN v USING (w) GROUP BY doc_id""")
def encoded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document's words by rank among the 1,000 commonest, 3 for others, whatever the batches."""
    words = documents(spark, sf_dir).select("doc_id", F.posexplode(T.words_of(F.col("text"))).alias("i", "w"))
    top = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(1000)
    names = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "w"))).alias("v")).select(F.posexplode("v").alias("id", "v")).select((F.col("id") + 4).alias("id"), "v.w")
    coded = words.join(F.broadcast(names), "w", "left").groupBy("doc_id").agg(F.count("*").alias("n_ids"), F.array_sort(F.collect_list(F.struct("i", F.coalesce("id", F.lit(3)).alias("id")))).alias("x"))
    return coded.select("doc_id", "n_ids", F.md5(F.array_join(F.transform("x", lambda r: r["id"].cast("string")), " ")).alias("ids"))


@R.query(f"SELECT source, CAST(sum(n) AS BIGINT) AS n_tokens, CAST(floor(sum(n) * 0.1::DOUBLE) AS BIGINT) AS n_val, CAST(sum(n) - floor(sum(n) * 0.1::DOUBLE) AS BIGINT) AS n_train FROM (SELECT source, {NW} AS n FROM documents) GROUP BY source")
def tokenized_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each source and of its two sides: the last tenth of the stream, rounded down, is for validation."""
    t = counted(spark, sf_dir).groupBy("source").agg(F.sum("n_words").alias("n_tokens"))
    val = F.floor(F.col("n_tokens") * 0.1).cast("long")
    return t.select("source", "n_tokens", val.alias("n_val"), (F.col("n_tokens") - val).alias("n_train"))


@R.query("""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= floor(count(*) OVER (PARTITION BY source) * 0.15) AS val FROM documents),
u AS (SELECT source, doc_id FROM r WHERE val UNION ALL SELECT source, doc_id FROM r WHERE NOT val)
SELECT (SELECT count(*) FROM (SELECT source, doc_id FROM documents EXCEPT ALL FROM u)) AS lost, (SELECT count(*) FROM (FROM u EXCEPT ALL SELECT source, doc_id FROM documents)) AS added, (SELECT count(*) FROM u) AS n""")
def span_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of a stratified split put together again, against the whole, both ways."""
    whole = documents(spark, sf_dir).select("source", "doc_id")
    split = C.tail_split(whole, ["source"], "doc_id", 0.15)
    again = split.where("is_val").drop("is_val").unionByName(split.where("not is_val").drop("is_val"))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(whole.exceptAll(again), "lost").crossJoin(count(again.exceptAll(whole), "added")).crossJoin(count(again, "n"))  # one row each


@R.query("SELECT event_type AS run, count(*) AS steps, count(*) * 16 * 2048 AS tokens_seen FROM events GROUP BY event_type")
def tokens_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps times batch times window of each run."""
    steps = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run")).agg(F.count("*").alias("steps"))
    return steps.withColumn("tokens_seen", F.col("steps") * 16 * 2048)


PUBLISHED = [("src1", 0.5), ("src2", 0.625), ("src4", 0.75)]


@R.query("""WITH m AS (SELECT source, avg(quality) AS v FROM labels JOIN documents USING (doc_id) WHERE source NOT IN ('src1', 'src2', 'src3') GROUP BY source), p AS (SELECT * FROM (VALUES ('src1', 0.5), ('src2', 0.625), ('src4', 0.75)) t(source, v)), s AS (SELECT DISTINCT source FROM documents)
SELECT source, round(CAST(coalesce(m.v, p.v) AS DOUBLE), 6) AS reference, CASE WHEN m.v IS NOT NULL THEN 'measured' WHEN p.v IS NOT NULL THEN 'published' ELSE '' END AS kind FROM s LEFT JOIN m USING (source) LEFT JOIN p USING (source)""")
def reference_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's reference figure: the measured one, else the published one, else none."""
    docs = documents(spark, sf_dir).select("doc_id", "source")
    measured = table(spark, sf_dir, "labels").join(docs.where("source not in ('src1', 'src2', 'src3')"), "doc_id").groupBy("source").agg(F.avg("quality").alias("m"))
    published = spark.createDataFrame(PUBLISHED, "source string, p double")
    joined = docs.select("source").distinct().join(measured, "source", "left").join(F.broadcast(published), "source", "left")  # a constant of three rows
    kind = F.when(F.col("m").isNotNull(), "measured").when(F.col("p").isNotNull(), "published").otherwise("")
    return joined.select("source", F.round(F.coalesce("m", "p"), 6).alias("reference"), kind.alias("kind"))


@R.query("""WITH a AS (SELECT md5(coalesce(text, '')) AS h FROM documents WHERE doc_id % 2 = 0), b AS (SELECT md5(coalesce(text, '')) AS h FROM documents WHERE doc_id % 2 = 1), x AS (SELECT count(*) AS n FROM (FROM a EXCEPT ALL FROM b)), y AS (SELECT count(*) AS n FROM (FROM b EXCEPT ALL FROM a))
SELECT x.n AS only_a, y.n AS only_b, x.n + y.n = 0 AS identical FROM x, y""")
def split_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two halves of the corpus hold the same texts as often: the two splits compared are even and odd ids."""
    h = documents(spark, sf_dir).select((F.col("doc_id") % 2).alias("half"), F.md5("text").alias("h"))
    sides = h.groupBy("h").agg(F.count_if(F.col("half") == 0).alias("a"), F.count_if(F.col("half") == 1).alias("b"))
    over = lambda x, y: F.coalesce(F.sum(F.greatest(F.col(x) - F.col(y), F.lit(0))), F.lit(0).cast("long"))
    return sides.agg(over("a", "b").alias("only_a"), over("b", "a").alias("only_b")).withColumn("identical", F.col("only_a") + F.col("only_b") == 0)


def sampling_problem(n: Column, temperature: Column, top_p: Column, top_k: Column) -> Column:
    """What is wrong with sampling arguments, null if nothing is."""
    return F.when(n < 1, "num_samples must be >= 1").when(temperature <= 0, "temperature must be > 0").when((top_p <= 0) | (top_p > 1), "top_p must be in (0, 1]").when(top_k < 0, "top_k must be >= 0")


@R.query("""SELECT p_partkey, CASE WHEN p_partkey % 3 < 1 THEN 'num_samples must be >= 1' WHEN (p_size - 3) / 10.0 <= 0 THEN 'temperature must be > 0' WHEN p_retailprice / 1500.0 <= 0 OR p_retailprice / 1500.0 > 1 THEN 'top_p must be in (0, 1]'
WHEN p_partkey % 5 - 1 < 0 THEN 'top_k must be >= 0' END AS problem FROM part""")
def argument_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", sampling_problem(F.col("p_partkey") % 3, (F.col("p_size") - 3) / 10.0, F.col("p_retailprice") / 1500.0, F.col("p_partkey") % 5 - 1).alias("problem"))


@R.query("""WITH s AS (SELECT source, avg(quality) AS score, stddev_samp(quality) / sqrt(count(*)) AS se FROM labels JOIN documents USING (doc_id) GROUP BY source)
SELECT source, round(score, 6) AS score, CASE WHEN NOT (coalesce(se, 0) <= 0 OR abs((score - 0.8) / se) < 2) THEN round(score, 6) END AS reportable FROM s""")
def reportable_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores that may be quoted: null where the verdict is at chance or there is no standard error."""
    s = table(spark, sf_dir, "labels").join(documents(spark, sf_dir).select("doc_id", "source"), "doc_id").groupBy("source").agg(F.avg("quality").alias("score"), (F.stddev_samp("quality") / F.sqrt(F.count("*"))).alias("se"))
    verdict = S.chance_verdict(F.col("score"), F.lit(0.8), F.col("se"))
    return s.select("source", F.round("score", 6).alias("score"), F.when(~verdict.isin("AT CHANCE", "no stderr"), F.round("score", 6)).alias("reportable"))


KEEP = [4, 1, 7]


@R.query("SELECT vec_id AS id, CAST(list_position([4, 1, 7], label) - 1 AS INTEGER) AS label FROM embeddings WHERE label IN (4, 1, 7)")
def relabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the chosen classes, labelled by the place of their class among those."""
    place = F.array_position(F.array(*map(F.lit, KEEP)), F.col("label"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (place - 1).cast("int").alias("label")).where("label >= 0")


@R.query("""WITH t AS (SELECT DISTINCT p_size * 11 AS tiles FROM part), g AS (SELECT r, c, r * c AS cores FROM range(1, 11) a(r), range(1, 12) b(c)), x AS (SELECT tiles, arg_max(g, (cores, -r, -c)) AS g FROM t JOIN g ON tiles % cores = 0 GROUP BY tiles)
SELECT tiles, CAST(g.cores AS INTEGER) AS cores, CAST(g.r AS INTEGER) AS n_rows, CAST(g.c AS INTEGER) AS n_cols FROM x""")
def best_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest grid within 10 x 11 whose cores divide the tiles, the first by rows and columns among equals."""
    tiles = table(spark, sf_dir, "part").select((F.col("p_size") * 11).alias("tiles")).distinct()
    grids = F.broadcast(spark.createDataFrame([(r * c, r, c) for r in range(1, 11) for c in range(1, 12)], "cores int, n_rows int, n_cols int"))  # a constant
    fits = tiles.join(grids, F.col("tiles") % F.col("cores") == 0)
    best = fits.groupBy("tiles").agg(F.max(F.struct("cores", (-F.col("n_rows")).alias("r"), (-F.col("n_cols")).alias("c"))).alias("g"))
    return best.select("tiles", "g.cores", (-F.col("g.r")).alias("n_rows"), (-F.col("g.c")).alias("n_cols"))


@R.query(f"""WITH {REG_SQL}, {AVAIL_SQL} SELECT rpad(name, 22, ' ') || ' ' || lpad(regexp_replace(printf('%.3f', share * 100), '\\.?0+$', '') || '%', 7, ' ') || ' ' || lpad(format('{{:,}}', CAST(round_even(share * {BUDGET}, 0) AS BIGINT)), 13, ' ') || ' '
|| lpad(format('{{:,}}', coalesce(tokens, 0)), 13, ' ') || ' ' || lpad(CAST(upsample AS VARCHAR), 4, ' ') || ' words' AS line FROM reg LEFT JOIN avail ON name = source""")
def gate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line a source: share, tokens it needs and has, upsampling."""
    joined = reg(spark).join(C.availability(documents(spark, sf_dir)), F.col("name") == F.col("source"), "left")
    line = F.format_string("%-22s %7s %,13d %,13d %4d words", "name", C.format_share(F.col("target_share")), C.required(F.col("target_share"), BUDGET), F.coalesce("tokens", F.lit(0).cast("long")), "upsample")
    return joined.select(line.alias("line"))


SIDES = "CASE doc_id % 4 WHEN 0 THEN 'Train_ids.npy' WHEN 1 THEN 'val_ids.npy' WHEN 2 THEN 'train_val.npy' ELSE 'ids.npy' END"


@R.query(f"SELECT side, count(*) AS n FROM (SELECT CASE WHEN contains(f, 'val') AND NOT contains(f, 'train') THEN 'val' WHEN contains(f, 'train') AND NOT contains(f, 'val') THEN 'train' END AS side FROM (SELECT lower({SIDES}) AS f FROM documents)) GROUP BY side")
def split_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side that a file's name tells; null if it tells none or both."""
    f = documents(spark, sf_dir).select(F.lower(F.expr(SIDES)).alias("f"))
    val, train = F.contains("f", F.lit("val")), F.contains("f", F.lit("train"))
    return f.groupBy(F.when(val & ~train, "val").when(train & ~val, "train").alias("side")).agg(F.count("*").alias("n"))


@R.query("SELECT source, doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS place FROM documents")
def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources one after the other by name: each document's place. Counts of sources are accumulated, not rows."""
    docs = documents(spark, sf_dir).select("source", "doc_id")
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    ahead = n.alias("a").join(n.alias("b"), F.col("b.source") < F.col("a.source"), "left").groupBy(F.col("a.source").alias("source")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("first"))
    ranked = running_total(docs, ["source"], "doc_id", F.lit(1), "rank")
    return ranked.join(small(ahead), "source").select("source", "doc_id", (F.col("first") + F.col("rank")).cast("long").alias("place"))


def learning_rate(step: Column, total: int, base: float, least: float, hold: float, warm: float, shape: str) -> Column:
    """The rate at a step: a warm-up, the base for the share ``hold`` of the run, then a fall to ``least``."""
    t = (step / total - hold) / (1 - hold)
    fall = least + 0.5 * (base - least) * (1 + F.cos(F.lit(3.141592653589793) * t)) if shape == "cosine" else base + (least - base) * t
    return F.when(step < warm * total, base * (step / (warm * total))).when(step / total <= hold, F.lit(base)).otherwise(fall)


@R.query("""SELECT CAST(s AS BIGINT) AS step, round(CASE WHEN s < 20 THEN 0.01 * (s / 20) WHEN s / 200 <= 0.25 THEN 0.01 ELSE 0.001 + 0.5 * 0.009 * (1 + cos(pi() * (s / 200 - 0.25) / 0.75)) END, 9) AS cosine,
round(CASE WHEN s < 20 THEN 0.01 * (s / 20) WHEN s / 200 <= 0.25 THEN 0.01 ELSE 0.01 - 0.009 * ((s / 200 - 0.25) / 0.75) END, 9) AS linear, CAST(least(200 - s, 32 - s % 32, 50 - s % 50) AS BIGINT) AS chunk, s % 50 = 0 OR s = 200 AS at_boundary FROM range(0, 201) t(s)""")
def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of a run of 200 steps, and the steps until it saves, validates or ends."""
    s = F.col("id")
    rate = lambda shape: F.round(learning_rate(s, 200, 0.01, 0.001, 0.25, 0.1, shape), 9).alias(shape)
    return spark.range(201).select(s.alias("step"), rate("cosine"), rate("linear"), F.least(200 - s, 32 - s % 32, 50 - s % 50).alias("chunk"), ((s % 50 == 0) | (s == 200)).alias("at_boundary"))


@R.query("SELECT cell, 1234 + cell * 7919 AS seed FROM range(0, 110) t(cell)")
def core_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(110).select(F.col("id").alias("cell"), (1234 + F.col("id") * 7919).alias("seed"))


QUERIES, ORACLE = R.queries, R.oracle
