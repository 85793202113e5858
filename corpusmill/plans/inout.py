"""Queries over sources and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.plans.base import DIRTY, Registry, table
from corpusmill.plans.texts import documents
from corpusmill.sources import readers
from corpusmill.sources.sinks import content_digest
from corpusmill.streaming import streams

R = Registry()


@R.query("SELECT CASE doc_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'skipped' WHEN 2 THEN 'empty' WHEN 3 THEN 'skipped' ELSE 'skipped' END AS status, count(*) AS n FROM documents GROUP BY 1")
def jsonl_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of five kinds: an object with text, a list, an object without text, a broken line, a number as text."""
    line = F.expr("""CASE doc_id % 5 WHEN 0 THEN to_json(named_struct('text', text)) WHEN 1 THEN '["text"]' WHEN 2 THEN '{"other": 1}' WHEN 3 THEN '{"text": "x' ELSE '{"text": 5}' END""")
    return readers.jsonl(documents(spark, sf_dir).select(line.alias("value"))).groupBy("status").agg(F.count("*").alias("n"))


@R.query("SELECT source, count(*) AS n FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 120) WHERE lang = 'en' GROUP BY source")
def scan_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The budget of 120 rows counts rows read, not kept (a feature of the scan)."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return readers.budgeted(rows, "doc_id", 120).where("lang = 'en'").groupBy("source").agg(F.count("*").alias("n"))


@R.query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' ELSE 'Question: ' || trim(text) || chr(10) || chr(10) || CASE WHEN turn % 2 = 0 THEN role || chr(10) || chr(10) ELSE '' END || 'Answer: ' || conv_id END AS rendered FROM conversations""")
def rendered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    answer = F.when(F.col("turn") % 3 == 0, F.lit(" ")).otherwise(F.col("conv_id").cast("string"))
    return c.select("conv_id", "turn", readers.question_answer(F.col("text"), F.when(F.col("turn") % 2 == 0, F.col("role")), answer).alias("rendered"))


@R.query("""WITH p AS (SELECT conv_id, list_filter(list_transform(string_split(string_agg(text, '</s>' ORDER BY turn) || '</s> </s>', '</s>'), lambda x: trim(x)), lambda x: x <> '') AS s FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS story_no, md5(unnest(s)) AS digest FROM p""")
def story_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    blob = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat(F.array_join(turns, "</s>"), F.lit("</s> </s>")).alias("blob"))
    return readers.stories(blob, "conv_id", "blob").select("conv_id", "story_no", F.md5("text").alias("digest"))


@R.query("SELECT item_id, 'c' || item_id AS context, md5(text) AS digest FROM benchmark")
def request_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both forms of a request log."""
    b = table(spark, sf_dir, "benchmark")
    context = F.concat(F.lit("c"), F.col("item_id").cast("string"))
    nested = F.to_json(F.struct(F.struct(context.alias("arg_0"), F.col("text").alias("arg_1")).alias("gen_args_0")))
    listed = F.to_json(F.array(F.array(context, F.col("text"))))
    form = F.when(F.col("item_id") % 2 == 0, nested).otherwise(listed)
    return b.select("item_id", F.inline(readers.request_texts(form))).select("item_id", "context", F.md5("continuation").alias("digest"))


@R.query("SELECT 'run/model_step_' || (max(o_orderkey) % 1000 + max(o_orderkey)) || '.bin' AS path, CAST(max(o_orderkey) + max(o_orderkey) % 1000 AS BIGINT) AS step FROM orders WHERE o_orderkey = (SELECT arg_max(o_orderkey, o_orderkey % 1000 + o_orderkey) FROM orders)")
def newest_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = (F.col("o_orderkey") % 1000 + F.col("o_orderkey")).cast("string")
    return readers.newest(table(spark, sf_dir, "orders").select(F.concat(F.lit("run/model_step_"), step, F.lit(".bin")).alias("path")))


@R.query("SELECT event_type AS run, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS step, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def last_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), F.datediff(F.to_date("ts"), F.to_date(F.lit("2024-01-01"))).cast("long").alias("step"), "event_id", "value")
    return e.groupBy("run", "step").agg(F.max_by("value", "event_id").alias("value"))


@R.query()
def corpus_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_digest(documents(spark, sf_dir))


@R.query(f"""WITH d AS (SELECT doc_id, source, {DIRTY} AS t FROM documents)
SELECT source, count(*) AS n, count(*) FILTER (doc_id % 5 = 0) AS n_both, count(*) FILTER (doc_id % 5 = 4) AS n_start FROM d GROUP BY source""")
def doc_stream_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cleaned as a stream, then counted as a table."""
    stream = streams.from_table(spark, sf_dir, "documents").withColumn("text", F.expr(DIRTY))
    done = streams.run_available(streams.cleaned(stream), streams.work_dir(spark))
    status = lambda s: F.count_if(F.col("status") == s)
    return done.groupBy("source").agg(F.count("*").alias("n"), status("both").alias("n_both"), status("start-only").alias("n_start"))


@R.query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's aggregate over the table: what the stream gives once all hours are final."""
    return streams.hourly(table(spark, sf_dir, "events")).select("hour", "event_type", "n", F.round("total", 6).alias("total"))


@R.query()
def events_hourly_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that the watermark has closed."""
    return streams.run_available(streams.hourly(streams.from_table(spark, sf_dir, "events")), streams.work_dir(spark))


@R.query("SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS BIGINT) AS n_words FROM documents WHERE trim(text) <> ''")
def text_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of two columns of which Parquet reads no others."""
    return table(spark, sf_dir, "documents").where(~T.blank(F.col("text"))).select("doc_id", F.size(T.words_of(F.col("text"))).cast("long").alias("n_words"))


QUERIES, ORACLE = R.queries, R.oracle
