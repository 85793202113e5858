"""Queries over corpus composition."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import compose as C
from corpusmill.operators.prefix import running_total
from corpusmill.operators.shared import written
from corpusmill.plans.base import DIRTY, Registry, quoted, table
from corpusmill.plans.texts import HARM, IMPROV_SQL, SENTENCES_SQL, TURNS_SQL, dirty, documents, turn_pairs

R = Registry()
BUDGET = 900_000
NAMES = [f"src{i}" for i in range(20)]
#: name, slice, share, upsample, rows per document, share-alike.
ROWS = [(n, C.SLICES[i % 8], (i + 1) / 210, 1 + i % 4, 1 + i % 3, i % 3 == 0) for i, n in enumerate(NAMES)]
REG_SQL = "reg AS (SELECT 'src' || i AS name, (i + 1) / 210 AS share, 1 + i % 4 AS upsample, i % 3 = 0 AS share_alike FROM range(0, 20) t(i))"
NW = "CAST(len(list_filter(regexp_split_to_array(text, '[\\t-\\r ]+'), lambda x: x <> '')) AS BIGINT)"
AVAIL_SQL = f"w AS (SELECT source, doc_id, {NW} AS n FROM documents), avail AS (SELECT source, CAST(sum(n) AS BIGINT) AS words, CAST(floor(sum(n) * 1.3) AS BIGINT) AS tokens FROM w GROUP BY source)"


def reg(spark: SparkSession) -> DataFrame:
    return C.registry(spark, ROWS)


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("source", "doc_id", T.word_count(F.col("text")).alias("n_words"))


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, want, words, tokens, upsample, target) for nine tenths of the largest budget that all can supply."""
    avail = written(C.availability(documents(spark, sf_dir)))  # one row a source
    budget = C.largest_budget(reg(spark), avail).first()["budget"]
    return C.plan_blend(reg(spark), avail, F.lit(math.floor(0.9 * budget)))


PLAN_SQL = f"{REG_SQL}, {AVAIL_SQL}, bud AS (SELECT floor(0.9::DOUBLE * min(coalesce(tokens, 0) * upsample / share)) AS budget FROM reg LEFT JOIN avail ON name = source), plan AS (SELECT a.source, a.words, a.tokens, r.upsample, CAST(round_even(share * budget, 0) AS BIGINT) AS want FROM bud, reg r JOIN avail a ON r.name = a.source), planned AS (SELECT *, want / (tokens / words) AS target FROM plan WHERE want > 0)"
EMIT_SQL = f"""{PLAN_SQL}, p AS (SELECT source, target, words, unnest(range(0, greatest(CAST(ceil(target / words) AS INTEGER), 1))) AS pass_no FROM planned),
laid AS (SELECT w.source, p.pass_no, w.doc_id, w.n, p.target, sum(w.n) OVER (PARTITION BY w.source ORDER BY p.pass_no, w.doc_id) - w.n AS pos FROM w JOIN p USING (source)),
emitted AS (SELECT source, pass_no, doc_id, CASE WHEN pos + n < target THEN n ELSE CAST(floor(target - pos) AS BIGINT) END AS n_take FROM laid WHERE pos < target)"""


@R.query(f"""WITH d AS (SELECT source, {DIRTY} AS t FROM documents),
s AS (SELECT source, t, regexp_extract(t, '(?i)(?:^|\n)(\\*\\*\\*\\s*START OF TH(?:E|IS) PROJECT GUTENBERG (?:EBOOK|ETEXT)[^\n]*)', 1) AS a FROM d),
r AS (SELECT source, a, CASE WHEN a <> '' THEN substr(t, instr(t, a) + len(a)) ELSE t END AS t FROM s),
e AS (SELECT *, regexp_extract(t, '(?i)(?:^|\n)(\\*\\*\\*\\s*END OF TH(?:E|IS) PROJECT GUTENBERG (?:EBOOK|ETEXT)[^\n]*)', 1) AS b FROM r),
c AS (SELECT source, a <> '' AS s, b <> '' AS e, list_transform(string_split(trim(CASE WHEN b <> '' THEN substr(t, 1, instr(t, b) - 1) ELSE t END, chr(10)), chr(10))[1:40], lambda x: CASE WHEN trim(x, ' ' || chr(9) || chr(13)) = '' THEN 0
  WHEN regexp_matches(x, '(?i)^\\s*(?:(?:this\\s+)?e-?(?:book|text)\\s+was\\s+produced\\s+by\\b|(?-i:Produced\\s+by\\s+[A-Z])|transcribed\\s+from\\s+the\\b|.*?[\\w.+-]+@[\\w.-]+\\.\\w+)') THEN 1 ELSE 2 END) AS k FROM e)
SELECT source, count(*) AS n, count(*) FILTER (s AND e) AS n_both, count(*) FILTER (s AND NOT e) AS n_start_only, count(*) FILTER (e AND NOT s) AS n_end_only, count(*) FILTER (NOT s AND NOT e) AS n_none,
 CAST(sum(len(list_filter(k[1:coalesce(list_position(k, 2), len(k) + 1) - 1], lambda x: x = 1))) AS BIGINT) AS lines_removed FROM c GROUP BY source""")
def prepare_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = lambda s: F.count_if(F.col("status") == s)
    return C.cleaned(dirty(spark, sf_dir)).groupBy("source").agg(
        F.count("*").alias("n"), status("both").alias("n_both"), status("start-only").alias("n_start_only"), status("end-only").alias("n_end_only"), status("none").alias("n_none"), F.sum("removed").alias("lines_removed")
    )


@R.query("""WITH r AS (SELECT source, doc_id, text, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 3 AS g FROM documents WHERE trim(text) <> '')
SELECT source, CAST(g AS BIGINT) AS group_no, count(*) AS n_rows, md5(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS digest FROM r GROUP BY source, g""")
def prepare_grouped_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.grouped_documents(documents(spark, sf_dir), 3).select("source", "group_no", "n_rows", F.md5("text").alias("digest"))


@R.query(f"WITH {AVAIL_SQL} SELECT source, words, tokens FROM avail")
def source_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.availability(documents(spark, sf_dir))


@R.query(f"""WITH {REG_SQL}, {AVAIL_SQL} SELECT name, CAST(round_even(share * {BUDGET}, 0) AS BIGINT) AS required, coalesce(tokens, 0) AS available, coalesce(tokens, 0) * upsample AS achievable,
 round(round_even(share * {BUDGET}, 0) / nullif(tokens, 0), 6) AS needed_upsample FROM reg LEFT JOIN avail ON name = source WHERE coalesce(tokens, 0) * upsample < round_even(share * {BUDGET}, 0)""")
def source_shortfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that cannot supply their share, worst first (those with nothing before all others)."""
    found = C.shortfalls(reg(spark), C.availability(documents(spark, sf_dir)), BUDGET).where("short")
    return found.select("name", "required", "available", "achievable", F.round("needed_upsample", 6).alias("needed_upsample")).orderBy(F.col("needed_upsample").desc_nulls_first(), "name")


@R.query(f"WITH {PLAN_SQL} SELECT source, want, words, tokens, round(target, 6) AS target FROM planned")
def blend_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(spark, sf_dir).select("source", "want", "words", "tokens", F.round("target", 6).alias("target"))


@R.query(f"WITH {EMIT_SQL} SELECT source, CAST(pass_no AS INTEGER) AS pass_no, doc_id, CAST(n_take AS BIGINT) AS n_take FROM emitted")
def blend_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.emit(counted(spark, sf_dir), planned(spark, sf_dir))


@R.query(f"""WITH {EMIT_SQL}, t AS (SELECT source, CAST(sum(n_take) AS BIGINT) AS emitted_words FROM emitted GROUP BY source),
m AS (SELECT p.source, emitted_words, round(emitted_words / words, 4) AS repetition_factor, emitted_words / words <= upsample AS within_declared, emitted_words * (tokens / words) AS tk, want FROM t JOIN planned p USING (source))
SELECT source, emitted_words, repetition_factor, within_declared, round(tk / want - 1, 6) AS error, round(tk / sum(tk) OVER (), 6) AS achieved_share FROM m""")
def blend_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = planned(spark, sf_dir)
    total = C.emit(counted(spark, sf_dir), plan).groupBy("source").agg(F.sum("n_take").alias("emitted_words"))
    m = total.join(plan, "source").withColumn("tk", F.col("emitted_words") * (F.col("tokens") / F.col("words")))
    ratio = F.col("emitted_words") / F.col("words")
    return m.select("source", "emitted_words", F.round(ratio, 4).alias("repetition_factor"), (ratio <= F.col("upsample")).alias("within_declared"), F.round(F.col("tk") / F.col("want") - 1, 6).alias("error"), F.round(F.col("tk") / F.sum("tk").over(W.partitionBy()), 6).alias("achieved_share"))


@R.query(f"WITH {REG_SQL} SELECT share_alike, string_agg(name, ', ' ORDER BY share DESC) AS names, round(100 * sum(share), 6) AS percent FROM reg GROUP BY share_alike")
def blend_share_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("target_share", "name")), False), lambda x: x["name"]), ", ")
    return reg(spark).groupBy("share_alike").agg(names.alias("names"), F.round(100 * F.sum("target_share"), 6).alias("percent"))


@R.query(f"WITH {REG_SQL} SELECT name, regexp_replace(printf('%.3f', share * 100), '\\.?0+$', '') || '%' AS shown FROM reg")
def share_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reg(spark).select("name", C.format_share(F.col("target_share")).alias("shown"))


@R.query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, k > n - floor(n * 0.1) AS is_val FROM r")
def tail_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tail_split(documents(spark, sf_dir).select("doc_id"), [], "doc_id", 0.1)


@R.query("WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, doc_id, k <= floor(n * 0.15) AS is_val FROM r")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tail_split(documents(spark, sf_dir).select("source", "doc_id"), ["source"], "doc_id", 0.15)


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the number of words before them in the whole corpus."""
    return running_total(counted(spark, sf_dir).withColumn("all", F.lit(0)), ["all"], "doc_id", F.col("n_words"), "start").drop("all")


@R.query(f"""WITH w AS (SELECT doc_id, {NW} AS n FROM documents), o AS (SELECT doc_id, n, sum(n) OVER (ORDER BY doc_id) - n AS start, sum(n) OVER () AS total FROM w),
s AS (SELECT span, CAST(floor(any_value(total) * span / 10) AS BIGINT) AS lo, CAST(floor(any_value(total) * (span + 1) / 10) AS BIGINT) AS hi FROM o, range(0, 10) t(span) GROUP BY span)
SELECT CAST(span AS INTEGER) AS span, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words, min(doc_id) AS first_doc FROM o JOIN s ON start >= lo AND start < hi GROUP BY span""")
def span_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to spans of a tenth of all words, by where they start: a range join with ten rows."""
    o = offsets(spark, sf_dir)
    total = counted(spark, sf_dir).agg(F.sum("n_words").alias("total"))
    spans = total.select(F.explode(F.sequence(F.lit(0), F.lit(9))).alias("span"), "total").selectExpr("span", "cast(floor(total * span / 10) as bigint) lo", "cast(floor(total * (span + 1) / 10) as bigint) hi")
    joined = o.join(F.broadcast(spans), (F.col("start") >= F.col("lo")) & (F.col("start") < F.col("hi")))
    return joined.groupBy("span").agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"), F.min("doc_id").alias("first_doc"))


@R.query(f"WITH w AS (SELECT source, doc_id, {NW} AS n FROM documents), c AS (SELECT source, doc_id, sum(n) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM w) SELECT source, min(doc_id) AS boundary FROM c WHERE upto >= 3000 GROUP BY source")
def boundary_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each source with which 3,000 words are reached."""
    upto = running_total(counted(spark, sf_dir), ["source"], "doc_id", F.col("n_words"), "start")
    return upto.where(F.col("start") + F.col("n_words") >= 3000).groupBy("source").agg(F.min("doc_id").alias("boundary"))


@R.query(f"""WITH w AS (SELECT source, doc_id, {NW} AS n FROM documents), c AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM w), b AS (SELECT source, min(doc_id) AS boundary FROM c WHERE upto >= 3000 GROUP BY source),
t AS (SELECT source, doc_id, n, sum(n) OVER (PARTITION BY source ORDER BY doc_id) - n AS before FROM w JOIN b USING (source) WHERE doc_id > boundary)
SELECT source, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words FROM t WHERE before < 2000 GROUP BY source""")
def unseen_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after the boundary until 2,000 words; the last may run over."""
    rest = counted(spark, sf_dir).join(boundary_line(spark, sf_dir), "source").where("doc_id > boundary")
    before = running_total(rest, ["source"], "doc_id", F.col("n_words"), "before").where("before < 2000")
    return before.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"))


@R.query(f"""WITH w AS (SELECT source, doc_id, {NW} AS n FROM documents), v AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= floor(count(*) OVER (PARTITION BY source) * 0.15) AS val FROM w)
SELECT source, CAST(sum(n) AS BIGINT) AS n_words, CAST(coalesce(sum(n) FILTER (val), 0) AS BIGINT) AS val_words, CAST(coalesce(sum(n) FILTER (NOT val), 0) AS BIGINT) AS train_words, true AS adds_up, CAST(0 AS BIGINT) AS lost FROM v GROUP BY source""")
def split_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of either side against those of the whole, and rows of the source that neither side has."""
    words = counted(spark, sf_dir)
    split = C.tail_split(words, ["source"], "doc_id", 0.15)
    lost = words.join(split.select("doc_id"), "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("lost"))
    sides = split.groupBy("source").agg(F.sum("n_words").alias("n_words"), F.coalesce(F.sum(F.when(F.col("is_val"), F.col("n_words"))), F.lit(0).cast("long")).alias("val_words"), F.coalesce(F.sum(F.when(~F.col("is_val"), F.col("n_words"))), F.lit(0).cast("long")).alias("train_words"))
    return sides.join(lost, "source", "left").withColumn("adds_up", F.col("val_words") + F.col("train_words") == F.col("n_words")).withColumn("lost", F.coalesce("lost", F.lit(0).cast("long")))


IDS_SQL = "list_transform(list_filter(regexp_split_to_array({t}, '[\\t-\\r ]+'), lambda x: x <> ''), lambda x: CAST(len(x) + 3 AS INTEGER))"
SFT_SQL = f"""{TURNS_SQL}, i AS (SELECT conv_id, turn, {IDS_SQL.format(t='prompt')} AS p, {IDS_SQL.format(t='completion')} AS c FROM pairs),
e AS (SELECT conv_id, turn, len(p) AS np, len(p) + len(c) AS n, p || c AS ids, list_transform(range(1, len(p)), lambda x: -100) || c || [-100] AS labels FROM i WHERE len(p) > 0),
x AS (SELECT conv_id, turn, n, ids || list_transform(range(0, (32 - n % 32) % 32), lambda q: 0) AS input_ids, labels || list_transform(range(0, (32 - n % 32) % 32), lambda q: -100) AS labels FROM e)"""


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples of a user's and an assistant's turn; a token is a word's length plus 3."""
    ids = lambda c: F.transform(T.split_words(F.col(c)), lambda w: F.length(w) + 3)
    pairs = turn_pairs(spark, sf_dir).select("conv_id", "turn", ids("prompt").alias("p"), ids("completion").alias("c")).where(F.size("p") > 0)
    inputs, labels = C.sft_example(F.col("p"), F.col("c"))
    return pairs.select("conv_id", "turn", (F.size("p") + F.size("c")).alias("n"), inputs.alias("input_ids"), labels.alias("labels"))


@R.query(f"WITH {SFT_SQL} SELECT conv_id, turn, CAST(len(input_ids) AS BIGINT) AS n_padded, CAST(len(labels) AS BIGINT) AS n_labels, md5(array_to_string(input_ids, ' ')) AS ids, md5(array_to_string(labels, ' ')) AS targets FROM x")
def sft_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), " "))
    return examples(spark, sf_dir).select("conv_id", "turn", F.size("input_ids").cast("long").alias("n_padded"), F.size("labels").cast("long").alias("n_labels"), text("input_ids").alias("ids"), text("labels").alias("targets"))


@R.query(f"WITH {SFT_SQL} SELECT CASE WHEN turn % 2 = 0 THEN 'even' ELSE 'odd' END AS arm, count(*) AS n, count(*) FILTER (n > 64) AS n_truncated, round(100.0 * count(*) FILTER (n > 64) / count(*), 6) AS percent FROM x GROUP BY 1")
def sft_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    arm = F.when(F.col("turn") % 2 == 0, "even").otherwise("odd").alias("arm")
    over = F.count_if(F.col("n") > 64)
    return examples(spark, sf_dir).groupBy(arm).agg(F.count("*").alias("n"), over.alias("n_truncated"), F.round(100.0 * over / F.count("*"), 6).alias("percent"))


#: The cut of a story, from 2 to n - 2 sentences, by a hash that both engines have.
CUT = "(CAST(doc_id * 7919 % 1000003 AS INT) % (n - 3)) + 2"


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = documents(spark, sf_dir).select("doc_id", T.sentences(F.col("text")).alias("s")).withColumn("n", F.size("s"))
    cut = s.withColumn("k", F.when(F.col("n") >= 4, F.expr(CUT.replace("n - 3", "greatest(n - 3, 1)"))))
    return cut.select("doc_id", "n", "k", F.array_join(F.slice("s", F.lit(1), F.coalesce("k", F.lit(1))), " ").alias("prefix"), F.array_join(F.slice("s", F.coalesce("k", F.lit(1)) + 1, F.lit(2)), " ").alias("continuation"), F.get("s", F.col("k") - 1).alias("last"))


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Carried and fresh content words of each story's continuation."""
    w = stories(spark, sf_dir).select("*", T.improv_content(F.col("prefix")).alias("p"), T.improv_content(F.col("continuation")).alias("c"), T.improv_content(F.col("last")).alias("l"))
    fresh = F.filter("c", lambda x: ~F.array_contains("p", x))
    carried = F.filter("l", lambda x: F.array_contains("c", x))
    drop = F.when(F.col("n") < 4, "too_few_sentences").when((F.size(F.array_intersect("p", "c")) == 0) | (F.size(fresh) == 0), "no_carry_or_no_add").otherwise("kept")
    return w.withColumns({"fresh": fresh, "carried": carried, "status": drop})


STORY_SQL = f"""s AS (SELECT doc_id, {SENTENCES_SQL.format(t='text')} AS s FROM documents), n AS (SELECT *, CAST(len(s) AS INT) AS n FROM s),
k AS (SELECT *, CASE WHEN n >= 4 THEN {CUT.replace('n - 3', 'greatest(n - 3, 1)')} END AS k FROM n),
t AS (SELECT doc_id, n, k, array_to_string(s[1:k], ' ') AS prefix, array_to_string(s[k + 1:k + 2], ' ') AS continuation, s[k] AS last FROM k),
w AS (SELECT *, {IMPROV_SQL.format(t='prefix')} AS p, {IMPROV_SQL.format(t='continuation')} AS c, {IMPROV_SQL.format(t='last')} AS l FROM t),
st AS (SELECT *, list_filter(c, lambda x: NOT list_contains(p, x)) AS fresh, list_filter(l, lambda x: list_contains(c, x)) AS carried,
 CASE WHEN n < 4 THEN 'too_few_sentences' WHEN NOT list_has_any(p, c) OR len(list_filter(c, lambda x: NOT list_contains(p, x))) = 0 THEN 'no_carry_or_no_add' ELSE 'kept' END AS status FROM w)"""


@R.query(f"""WITH {STORY_SQL}, q AS (SELECT *, 100.0 * len(list_filter(c, lambda x: list_contains({quoted(HARM)}, x))) / len(c) - 100.0 * len(list_filter(p, lambda x: list_contains({quoted(HARM)}, x))) / len(p) AS delta FROM st WHERE status = 'kept')
SELECT doc_id, CAST(k AS BIGINT) AS cut_k, coalesce(nullif(array_to_string(l[1:12], ' '), ''), last[1:60]) AS offer, CASE WHEN len(carried) > 0 THEN array_to_string(carried[1:6], ' ') ELSE list_sort(list_transform(list_distinct(list_filter(p, lambda x: list_contains(c, x))), lambda x: {{'k': -len(list_filter(p, lambda y: y = x)), 'w': x}}))[1].w END AS accept, CASE WHEN delta > 0.5 THEN 'up' WHEN delta < -0.5 THEN 'down' ELSE 'level' END AS stakes,
 coalesce(list_filter({IMPROV_SQL.format(t=SENTENCES_SQL.format(t='continuation') + '[-1]')}, lambda x: list_contains(fresh, x))[-1], 'open') AS handback FROM q""")
def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of the kept stories (the add slot is in trace_adds). Where the last sentence before the cut carries no
    word on, the commonest word of the prefix that comes again is accepted, the first by letter among equals."""
    s = slots(spark, sf_dir).where("status = 'kept'")
    again = F.transform(F.array_intersect("p", "c"), lambda w: F.struct((-F.size(F.filter("p", lambda x: x == w))).alias("n"), w.alias("w")))
    s = s.withColumn("carried", F.when(F.size("carried") > 0, F.col("carried")).otherwise(F.array(F.array_min(again)["w"])))
    delta = T.intensity(F.col("continuation"), HARM) - T.intensity(F.col("prefix"), HARM)
    tail = s.withColumn("tail", T.improv_content(F.try_element_at(T.sentences(F.col("continuation")), F.lit(-1))))
    back = F.filter("tail", lambda x: F.array_contains("fresh", x))
    offer = F.array_join(F.slice("l", 1, 12), " ")
    return tail.select("doc_id", F.col("k").cast("long").alias("cut_k"), F.when(offer != "", offer).otherwise(F.substring("last", 1, 60)).alias("offer"), F.array_join(F.slice("carried", 1, 6), " ").alias("accept"), F.when(delta > 0.5, "up").when(delta < -0.5, "down").otherwise("level").alias("stakes"), F.coalesce(F.try_element_at(back, F.lit(-1)), F.lit("open")).alias("handback"))


@R.query(f"""WITH {STORY_SQL}, df AS (SELECT x, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({IMPROV_SQL.format(t='text')}) AS x FROM documents) GROUP BY x), t2 AS (SELECT count(*) AS n FROM documents),
f AS (SELECT DISTINCT doc_id, unnest(fresh) AS x FROM st WHERE status = 'kept'), r AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY round(ln(t2.n / (1 + df)), 9) DESC, x) AS k FROM f JOIN df USING (x), t2)
SELECT doc_id, x AS add FROM r WHERE k = 1""")
def trace_adds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fresh word of the largest inverse document frequency, the first by letter among equals."""
    docs = documents(spark, sf_dir)
    df = docs.select(F.explode(F.array_distinct(T.improv_content(F.col("text")))).alias("x")).groupBy("x").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("total"))
    fresh = slots(spark, sf_dir).where("status = 'kept'").select("doc_id", F.explode(F.array_distinct("fresh")).alias("x"))
    scored = fresh.join(df, "x").crossJoin(F.broadcast(n)).withColumn("idf", F.round(F.ln(F.col("total") / (1 + F.col("df"))), 9))
    return scored.groupBy("doc_id").agg(F.min(F.struct((-F.col("idf")).alias("i"), "x")).alias("m")).select("doc_id", F.col("m.x").alias("add"))


@R.query(f"WITH {STORY_SQL} SELECT status, count(*) AS n FROM st GROUP BY status")
def trace_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@R.query(f"WITH {STORY_SQL} SELECT doc_id, md5(prefix) AS opening FROM st WHERE n >= 4 AND doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 50")
def heldout_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 50 openings of stories without a label (a feature: the number asked for)."""
    labels = table(spark, sf_dir, "labels").select("doc_id")
    return stories(spark, sf_dir).where("n >= 4").join(labels, "doc_id", "left_anti").orderBy("doc_id").limit(50).select("doc_id", F.md5("prefix").alias("opening"))


SELECTORS = [("steel", ["green"], ["STEEL"]), ("copper", [], ["copper"]), ("red", ["Red"], []), ("none", [], [])]


@R.query("""WITH sel AS (SELECT * FROM (VALUES ('steel', 'green', 'steel'), ('copper', NULL, 'copper'), ('red', 'red', NULL), ('none', NULL, NULL)) t(name, a, b))
SELECT name, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys FROM part, sel WHERE coalesce(contains(lower(p_name), a), false) OR coalesce(contains(lower(p_type), b), false) GROUP BY name""")
def selector_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to all sources of which a selector is part of their name or type; a source without selectors gets none."""
    sel = spark.createDataFrame(SELECTORS, "name string, authors array<string>, shelves array<string>")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    # The registry is a constant of a few rows.
    routed = parts.join(F.broadcast(sel), C.matches(F.col("p_name"), F.col("p_type"), F.col("authors"), F.col("shelves")))
    return routed.groupBy("name").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


QUERIES, ORACLE = R.queries, R.oracle
