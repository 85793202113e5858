"""Queries over the text scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusmill.functions import text as T
from corpusmill.plans.base import DIRTY, Registry, quoted, table

R = Registry()
#: Word lists of our own for intensity and closure.
HARM = ["the", "shst", "erth", "stupid", "idiot", "pathetic", "scum", "anea"]
CLOSURE = ["ened", "the end", "ingst", "of the"]

WORDS_SQL = "regexp_extract_all(lower(text), '[a-z0-9'']+')"
BEHAVIOUR_SQL = f"list_transform(list_filter({{w}}, lambda x: len(x) > 2 AND NOT list_contains({quoted(T.BEHAVIOUR_STOPWORDS)}, x)), lambda x: CASE WHEN len(x) > 3 AND suffix(x, 's') AND NOT suffix(x, 'ss') THEN x[:-2] ELSE x END)"
IMPROV_SQL = f"list_filter(list_transform(regexp_extract_all({{t}}, '[A-Za-z'']+'), lambda x: lower(x)), lambda x: NOT list_contains({quoted(T.IMPROV_STOPWORDS)}, x))"
SENTENCES_SQL = "list_filter(list_transform(string_split(regexp_replace(trim({t}), '([.!?\"])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
#: Pairs of turns: a user's and the next one's, the assistant's.
TURNS_SQL = """turns AS (SELECT conv_id, turn, role, text AS prompt, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS r2,
 lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS completion FROM conversations),
pairs AS (SELECT conv_id, turn, prompt, completion FROM turns WHERE role = 'user' AND r2 = 'assistant')"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumn("text", F.expr(DIRTY))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("prompt"), F.lead("role").over(w).alias("r2"), F.lead("text").over(w).alias("completion"))
    return turns.where("role = 'user' AND r2 = 'assistant'").select("conv_id", "turn", "prompt", "completion")


@R.query(f"""
WITH d AS (SELECT source, {WORDS_SQL} AS w FROM (SELECT source, rtrim(replace(text, chr(13), chr(10))) AS text FROM documents)),
r AS (SELECT source, 1 - len(list_distinct(g)) / len(g) AS rate FROM (SELECT source, list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) AS g FROM d WHERE len(w) >= 4))
SELECT source, round(avg(rate), 6) AS mean_rate, round(coalesce(stddev_samp(rate) / sqrt(count(*)), 0), 6) AS sem, count(*) AS n FROM r GROUP BY source""")
def source_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean 4-gram repeat rate of the cleaned documents of each source, with its standard error."""
    words = documents(spark, sf_dir).select("source", T.words_of(T.normalise(F.col("text"))).alias("w"))
    rates = words.select("source", T.repeat_rate(F.col("w")).alias("rate"))
    n = F.count("rate")
    return rates.groupBy("source").agg(F.round(F.avg("rate"), 6).alias("mean_rate"), F.round(F.coalesce(F.stddev_samp("rate") / F.sqrt(n), F.lit(0.0)), 6).alias("sem"), n.alias("n")).where("n > 0")


@R.query(f"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+(\n|$)', '\\1', 'g'), '\n\n\n+', chr(10) || chr(10), 'g'), chr(10))) AS digest
FROM (SELECT doc_id, {DIRTY} AS t FROM documents)""")
def doc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty(spark, sf_dir).select("doc_id", F.md5(T.normalise(F.col("text"))).alias("digest"))


@R.query(f"""WITH d AS (SELECT doc_id, {DIRTY} AS t FROM documents),
s AS (SELECT doc_id, t, regexp_extract(t, '(?i)(?:^|\n)(\\*\\*\\*\\s*START OF TH(?:E|IS) PROJECT GUTENBERG (?:EBOOK|ETEXT)[^\n]*)', 1) AS a FROM d),
r AS (SELECT doc_id, a, CASE WHEN a <> '' THEN substr(t, instr(t, a) + len(a)) ELSE t END AS t FROM s),
e AS (SELECT *, regexp_extract(t, '(?i)(?:^|\n)(\\*\\*\\*\\s*END OF TH(?:E|IS) PROJECT GUTENBERG (?:EBOOK|ETEXT)[^\n]*)', 1) AS b FROM r)
SELECT doc_id, CASE WHEN a <> '' AND b <> '' THEN 'both' WHEN a <> '' THEN 'start-only' WHEN b <> '' THEN 'end-only' ELSE 'none' END AS status,
 md5(trim(CASE WHEN b <> '' THEN substr(t, 1, instr(t, b) - 1) ELSE t END, chr(10))) AS digest FROM e""")
def doc_boilerplate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dirty(spark, sf_dir).select("doc_id", T.strip_boilerplate(F.col("text")).alias("c"))
    return cut.select("doc_id", "c.status", F.md5("c.text").alias("digest"))


@R.query(f"""WITH d AS (SELECT doc_id, {DIRTY} AS t FROM documents),
l AS (SELECT doc_id, t, string_split(t, chr(10)) AS l FROM d),
k AS (SELECT *, list_transform(l[1:40], lambda x: CASE WHEN trim(x, ' ' || chr(9) || chr(13)) = '' THEN 0
  WHEN regexp_matches(x, '(?i)^\\s*(?:(?:this\\s+)?e-?(?:book|text)\\s+was\\s+produced\\s+by\\b|(?-i:Produced\\s+by\\s+[A-Z])|transcribed\\s+from\\s+the\\b|.*?[\\w.+-]+@[\\w.-]+\\.\\w+)') THEN 1 ELSE 2 END) AS c FROM l),
n AS (SELECT *, coalesce(list_position(c, 2), len(c) + 1) - 1 AS lead FROM k),
m AS (SELECT *, len(list_filter(c[1:lead], lambda x: x = 1)) AS removed FROM n)
SELECT doc_id, CAST(removed AS BIGINT) AS removed, md5(CASE WHEN removed > 0 THEN ltrim(array_to_string(l[lead + 1:], chr(10)), chr(10)) ELSE t END) AS digest FROM m""")
def doc_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dirty(spark, sf_dir).select("doc_id", T.strip_front_matter(F.col("text")).alias("c"))
    return cut.select("doc_id", "c.removed", F.md5("c.text").alias("digest"))


@R.query(f"""SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(t, '[\\t-\\r ]+'), lambda x: x <> '')) AS BIGINT) AS n_words,
 CAST(len(list_filter(string_split(t, chr(10) || chr(10)), lambda p: regexp_matches(p, '[^\\t-\\r ]'))) AS BIGINT) AS n_paragraphs FROM (SELECT doc_id, {DIRTY} AS t FROM documents)""")
def doc_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return dirty(spark, sf_dir).select("doc_id", T.word_count(c).alias("n_words"), F.size(T.paragraphs(c)).cast("long").alias("n_paragraphs"))


@R.query(f"""WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS no
  FROM (SELECT doc_id, concat({DIRTY}, chr(10), '<|endoftext|>', chr(10), 'after') AS t FROM documents)),
c AS (SELECT doc_id, no, CASE WHEN line = '<|endoftext|>' THEN '</s>' ELSE line END AS line FROM (SELECT doc_id, no, regexp_replace(line, '\\s+$', '') AS line FROM l) WHERE line <> ''),
s AS (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY no) AS upto FROM c)
SELECT doc_id, count(*) AS n_lines, CAST(sum(strlen(line) + 1) AS BIGINT) AS n_bytes FROM s WHERE upto <= 2000 GROUP BY doc_id""")
def doc_line_clean_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned lines of each document up to 2,000 bytes, whole lines only. The running sum stays within the document's array."""
    raw = F.split(F.concat("text", F.lit("\n<|endoftext|>\nafter")), "\n")
    clean = F.filter(F.transform(raw, lambda x: F.regexp_replace(x, r"\s+$", "")), lambda x: x != "")
    lines = F.transform(clean, lambda x: F.when(x == "<|endoftext|>", F.lit(T.SEPARATOR)).otherwise(x))
    zero = F.struct(F.lit(0).cast("long").alias("all"), F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct(
        (a["all"] + F.octet_length(x) + 1).alias("all"),
        F.when(a["all"] + F.octet_length(x) + 1 <= 2000, a["bytes"] + F.octet_length(x) + 1).otherwise(a["bytes"]).alias("bytes"),
        F.when(a["all"] + F.octet_length(x) + 1 <= 2000, a["n"] + 1).otherwise(a["n"]).alias("n"),
    )
    done = dirty(spark, sf_dir).select("doc_id", F.aggregate(lines, zero, step).alias("a"))
    return done.select("doc_id", F.col("a.n").alias("n_lines"), F.col("a.bytes").alias("n_bytes")).where("n_lines > 0")


@R.query(f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, md5(array_to_string(s, chr(2))) AS digest FROM (SELECT doc_id, {SENTENCES_SQL.format(t='text')} AS s FROM documents)")
def doc_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = documents(spark, sf_dir).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "\x02")).alias("digest"))


@R.query(f"""SELECT doc_id, md5(array_to_string({BEHAVIOUR_SQL.format(w=WORDS_SQL)}, ' ')) AS stems, md5(array_to_string({IMPROV_SQL.format(t='text')}, ' ')) AS content FROM documents""")
def doc_content_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return documents(spark, sf_dir).select("doc_id", F.md5(F.array_join(T.behaviour_content(c), " ")).alias("stems"), F.md5(F.array_join(T.improv_content(c), " ")).alias("content"))


@R.query(f"""SELECT stem, count(*) AS n FROM (SELECT unnest(list_transform({WORDS_SQL}, lambda x: CASE WHEN len(x) > 3 AND suffix(x, 's') AND NOT suffix(x, 'ss') THEN x[:-2] ELSE x END)) AS stem FROM documents) GROUP BY stem""")
def doc_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = documents(spark, sf_dir).select(F.explode(T.words_of(F.col("text"))).alias("w"))
    return words.select(T.stem(F.col("w")).alias("stem")).groupBy("stem").agg(F.count("*").alias("n"))


@R.query(f"""SELECT doc_id, array_to_string(coalesce(list_sort(list_distinct(list_filter(list_transform(flatten(list_transform({SENTENCES_SQL.format(t='text')}, lambda s: list_filter(regexp_split_to_array(s, '\\s+'), lambda q: q <> '')[2:])),
 lambda x: regexp_extract(x, '^([A-Z][a-z]+)(?:[^\\p{{L}}\\p{{N}}_]|$)', 1)), lambda x: x <> ''))), []), ' ') AS names FROM documents""")
def doc_proper_nouns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.array_join(T.proper_nouns(F.col("text")), " ").alias("names"))


#: Text with markers in it, by doc_id.
TALE = """CASE doc_id % 7 WHEN 0 THEN concat('Once upon a time there was a little girl named Ana. ', text) WHEN 1 THEN concat(text, ' They lived happily ever after. The end.')
 WHEN 2 THEN concat('One day, his mom was so happy. ', text) WHEN 3 THEN concat(text, ' a cat named bob, a dog named Rex') WHEN 4 THEN concat('The moral of the story: they learned a lesson from that day on. ', text) ELSE text END"""
MARKERS_SQL = "list_filter([" + ", ".join("CASE WHEN regexp_matches({t}, '" + ("" if n in T.CASE_SENSITIVE_MARKERS else "(?i)") + p.replace("'", "''") + f"') THEN '{n}' END" for n, p in T.MARKERS) + "], lambda x: x IS NOT NULL)"


@R.query(f"""SELECT doc_id, array_to_string(m, ',') AS markers, len(m) > 0 AS collapsed, list_has_any(m, {quoted(T.FRAME_MARKERS)}) AS frame, len(list_filter(m, lambda x: NOT list_contains({quoted(T.FRAME_MARKERS)}, x))) > 0 AS lexical
FROM (SELECT doc_id, {MARKERS_SQL.format(t='t')} AS m FROM (SELECT doc_id, {TALE} AS t FROM documents))""")
def doc_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = documents(spark, sf_dir).select("doc_id", T.markers_found(F.expr(TALE)).alias("m"))
    lexical = F.array_except("m", F.array(*map(F.lit, T.FRAME_MARKERS)))
    return m.select("doc_id", F.array_join("m", ",").alias("markers"), (F.size("m") > 0).alias("collapsed"), T.frame_collapsed(F.col("m")).alias("frame"), (F.size(lexical) > 0).alias("lexical"))


@R.query(f"""SELECT source, marker, count(*) AS n, round(count(*) / any_value(total), 6) AS rate FROM
 (SELECT source, unnest({MARKERS_SQL.format(t='t')}) AS marker, total FROM (SELECT source, {TALE} AS t, count(*) OVER (PARTITION BY source) AS total FROM documents)) GROUP BY source, marker""")
def marker_rates_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = documents(spark, sf_dir).select("source", T.markers_found(F.expr(TALE)).alias("m"))
    counts = m.groupBy("source").agg(F.count("*").alias("total"))
    # One row for each source: bounded by the registry, joined by hash.
    hits = m.select("source", F.explode("m").alias("marker")).groupBy("source", "marker").agg(F.count("*").alias("n"))
    return hits.join(counts, "source").select("source", "marker", "n", F.round(F.col("n") / F.col("total"), 6).alias("rate"))


@R.query(f"""SELECT doc_id, CASE WHEN len(w) >= 4 THEN round(1 - len(list_distinct(g)) / len(g), 6) END AS rate FROM
 (SELECT doc_id, w, list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) AS g FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents))""")
def doc_repeat_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = documents(spark, sf_dir).select("doc_id", T.words_of(F.col("text")).alias("w"))
    return words.select("doc_id", F.round(T.repeat_rate(F.col("w")), 6).alias("rate"))


@R.query()
def doc_longest_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", T.longest_repeat(T.words_of(F.col("text"))).cast("long").alias("longest"))


@R.query(f"""WITH w AS (SELECT doc_id, w, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents)),
f AS (SELECT doc_id, x, i, lag(x, 1) OVER o AS a, lag(x, 2) OVER o AS b, lag(x, 3) OVER o AS c, lag(x, 4) OVER o AS d FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, avg(CASE WHEN x = a OR x = b OR x = c OR x = d THEN 1.0 ELSE 0.0 END) AS r FROM f GROUP BY doc_id)
SELECT doc_id, round(coalesce(r, 0), 6) AS rate FROM documents LEFT JOIN r USING (doc_id)""")
def doc_local_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = documents(spark, sf_dir).select("doc_id", T.words_of(F.col("text")).alias("w"))
    return words.select("doc_id", F.round(T.local_repeat(F.col("w")), 6).alias("rate"))


@R.query("""SELECT source, count(*) AS n, CAST(sum(CASE WHEN contains(t, '</s>') THEN 1 ELSE 0 END) AS BIGINT) AS n_with_separator
FROM (SELECT source, CASE WHEN doc_id % 3 = 0 THEN concat(text, chr(10), '</s>') ELSE text END AS t FROM documents) GROUP BY source""")
def doc_separator_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr("CASE WHEN doc_id % 3 = 0 THEN concat(text, chr(10), '</s>') ELSE text END")
    return documents(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count_if(t.contains(T.SEPARATOR)).alias("n_with_separator"))


P_SQL = BEHAVIOUR_SQL.format(w="regexp_extract_all(lower(prompt), '[a-z0-9'']+')")
C_SQL = BEHAVIOUR_SQL.format(w="regexp_extract_all(lower(completion), '[a-z0-9'']+')")


@R.query(f"""WITH {TURNS_SQL}, s AS (SELECT conv_id, turn, list_distinct({P_SQL}) AS p, {C_SQL} AS c FROM pairs)
SELECT conv_id, turn, CASE WHEN len(p) > 0 THEN round(len(list_intersect(p, c)) / len(p), 6) END AS engagement FROM s""")
def turn_engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", F.round(T.engagement(F.col("prompt"), F.col("completion")), 6).alias("engagement"))


@R.query(f"""WITH {TURNS_SQL}, s AS (SELECT conv_id, turn, regexp_extract_all(lower(prompt), '[a-z0-9'']+') AS p, regexp_extract_all(lower(completion), '[a-z0-9'']+') AS c FROM pairs),
n AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(p), len(c)) + 1), lambda i: p[i] = c[i]), false), least(len(p), len(c)) + 1) - 1 AS n FROM s)
SELECT conv_id, turn, CAST(n AS BIGINT) AS agreement, CASE WHEN n < least(len(p), len(c)) THEN p[n + 1] END AS a, CASE WHEN n < least(len(p), len(c)) THEN c[n + 1] END AS b FROM n""")
def turn_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = turn_pairs(spark, sf_dir).select("conv_id", "turn", T.words_of(F.col("prompt")).alias("p"), T.words_of(F.col("completion")).alias("c"))
    n = s.withColumn("agreement", T.leading_agreement(F.col("p"), F.col("c")))
    differ = F.col("agreement") < F.least(F.size("p"), F.size("c"))
    at = F.col("agreement").cast("int")
    return n.select("conv_id", "turn", "agreement", F.when(differ, F.get("p", at)).alias("a"), F.when(differ, F.get("c", at)).alias("b"))


def intensity_sql(t: str) -> str:
    words = IMPROV_SQL.format(t=t)
    return f"CASE WHEN len({words}) = 0 THEN 0 ELSE 100.0 * len(list_filter({words}, lambda q: list_contains({quoted(HARM)}, q))) / len({words}) END"


@R.query(f"WITH {TURNS_SQL} SELECT conv_id, turn, round({intensity_sql('prompt')}, 6) AS before, round({intensity_sql('completion')}, 6) AS after FROM pairs")
def turn_intensity_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", *[F.round(T.intensity(F.col(c), HARM), 6).alias(k) for c, k in (("prompt", "before"), ("completion", "after"))])


@R.query(f"""WITH {TURNS_SQL}, t AS (SELECT conv_id, turn, {SENTENCES_SQL.format(t='completion')}[-1] AS tail FROM pairs)
SELECT conv_id, turn, contains(lower(tail), 'the end') OR contains(lower(tail), 'of the') OR list_has_any(regexp_extract_all(lower(tail), '[a-z'']+'), ['ened', 'ingst']) AS closed FROM t""")
def turn_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", T.closed(F.try_element_at(T.sentences(F.col("completion")), F.lit(-1)), CLOSURE).alias("closed"))


THINK = """CASE turn % 4 WHEN 3 THEN concat('<think>', chr(10), 'offer: x', chr(10), '</think>') ELSE
 concat('pre <think>', chr(10), 'offer: ', role, chr(10), 'accept: a:b', chr(10), 'add: c', chr(10), 'stakes: ', CASE WHEN turn % 2 = 0 THEN 'up' ELSE 'sideways' END, chr(10), 'Handback: ', conv_id, chr(10), 'offer: second', chr(10), '</think>') END"""


@R.query("""SELECT conv_id, turn, turn % 4 <> 3 AND turn % 2 = 0 AS ok, CASE WHEN turn % 4 <> 3 AND turn % 2 = 0 THEN concat('<think>', chr(10), 'offer: second', chr(10), 'accept: a:b', chr(10), 'add: c', chr(10), 'stakes: up', chr(10), 'handback: ', conv_id, chr(10), '</think>', chr(10)) END AS rendered FROM conversations""")
def think_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks parsed (the last of two equal names counts, partial ones are null) and rendered again."""
    p = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.parse_think(F.expr(THINK)).alias("s"))
    return p.select("conv_id", "turn", F.col("s").isNotNull().alias("ok"), F.when(F.col("s").isNotNull(), T.render_think(**{k: F.col(f"s.{k}") for k in T.SLOTS})).alias("rendered"))


QUERIES, ORACLE = R.queries, R.oracle
