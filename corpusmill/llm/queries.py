"""Queries over the whole tables for the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import bpe, common, decontaminate, hdlang, html, repeats, rules, simhash, tokencounts, urlfilter, warc


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(common.table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json")))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(common.table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


#: A number from 0 to 4095 by the host's name, in terms that Spark and SQL share.
NUMBER = " + ".join(f"(instr('0123456789abcdef', substr(md5(host), {k}, 1)) - 1) * {16 ** (3 - k)}" for k in (1, 2, 3))
#: The list's log: pattern, verdict, day since 2024-01-01, action, and which hosts or domains have the entry.
ENTRIES = [
    ("host", "block", "x % 300", "add", "whole AND x % 4 <> 0"),
    ("host", "block", "x % 300 + 20 + x % 50", "remove", "whole AND x % 4 <> 0"),
    ("host", "block", "x % 300 + 100", "add", "whole AND x % 12 IN (3, 6, 9)"),
    ("host", "block", "x % 300 + 5", "add", "whole AND x % 5 = 0"),
    ("concat(host, '/en/')", "allow", "x % 200", "add", "whole AND x % 2 = 0"),
    ("concat(host, '/de/')", "block", "x % 200", "add", "whole AND x % 7 = 0"),
    ("concat(host, '/de/')", "block", "x % 200", "remove", "whole AND x % 7 = 0"),
    ("host", "block", "x % 300", "add", "NOT whole"),
    ("host", "block", "x % 300 + 15", "remove", "NOT whole"),
]


def url_list(pages: DataFrame) -> DataFrame:
    """The dated list of the query: entries for every host of the pages and for its last two labels."""
    hosts = pages.select(urlfilter.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    domains = hosts.select(F.substring_index("host", ".", -2).alias("host"), F.lit(False).alias("whole")).distinct()
    numbered = hosts.withColumn("whole", F.lit(True)).unionByName(domains).withColumn("x", F.expr(NUMBER))
    rows = ", ".join(f"named_struct('pattern', {p}, 'verdict', '{v}', 'day', date_add(DATE'2024-01-01', {d}), 'action', '{a}', 'has', {c})" for p, v, d, a, c in ENTRIES)
    return numbered.selectExpr(f"inline(array({rows}))").where("has").drop("has")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the list of its hosts; pages have no date, so that of a page follows from its id."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_on", F.expr("date_add(DATE'2024-01-01', cast(pmod(page_id * 37, 366) as int))"))
    return urlfilter.judged(captures, url_list(pages))


OP3_SQL = rf"""
WITH u AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(((page_id * 37) % 366 + 366) % 366 AS INTEGER) AS DATE) AS fetched_on,
    regexp_replace(lower(regexp_extract(coalesce(url, ''), '{urlfilter.HOST}', 1)), '\.+$', '') AS host, regexp_extract(coalesce(url, ''), '{urlfilter.PATH}', 1) AS path
  FROM pages
), hosts AS (SELECT DISTINCT host FROM u WHERE host <> ''),
named AS (SELECT host, true AS whole FROM hosts UNION ALL SELECT DISTINCT array_to_string(string_split(host, '.')[-2:], '.'), false FROM hosts),
numbered AS (SELECT *, {NUMBER} AS x FROM named),
log AS ({" UNION ALL ".join(f"SELECT {p} AS pattern, '{v}' AS verdict, CAST({d} AS INTEGER) AS day, '{a}' = 'add' AS listed FROM numbered WHERE {c}" for p, v, d, a, c in ENTRIES)}),
states AS (SELECT pattern, verdict, day, bool_or(listed) AS listed FROM log GROUP BY ALL),
changes AS (SELECT * FROM (SELECT *, coalesce(lag(listed) OVER (PARTITION BY pattern, verdict ORDER BY day), false) AS earlier FROM states) WHERE listed <> earlier),
spans AS (SELECT pattern, verdict, CAST(DATE '2024-01-01' + day AS DATE) AS valid_from, CAST(DATE '2024-01-01' + until AS DATE) AS valid_to
  FROM (SELECT *, lead(day) OVER (PARTITION BY pattern, verdict ORDER BY day) AS until FROM changes) WHERE listed),
tried AS (
  SELECT page_id, url, fetched_on, s.* FROM (SELECT *, CASE WHEN path = '' THEN '/' ELSE path END AS p FROM u) c
  JOIN spans s ON valid_from <= fetched_on AND (valid_to IS NULL OR fetched_on < valid_to) AND host <> ''
    AND CASE WHEN contains(pattern, '/') THEN host || p = pattern OR suffix(pattern, '/') AND prefix(host || p, pattern) ELSE host = pattern OR suffix(host, '.' || pattern) END
), best AS (
  SELECT page_id, count(*) AS n, arg_max(struct_pack(v := verdict, p := pattern, f := valid_from), (contains(pattern, '/'), len(pattern), verdict = 'allow', verdict)) AS b FROM tried GROUP BY page_id
)
SELECT u.page_id, u.url, fetched_on, CASE WHEN fetched_on IS NOT NULL THEN coalesce(b.v, 'allow') END AS verdict, b.p AS pattern, b.f AS valid_from, coalesce(n, 0) AS n_active
FROM u LEFT JOIN best USING (page_id)
"""


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    learned = rules.learn(docs, common.table(spark, sf_dir, "labels"))
    return rules.judged(docs, learned).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = warc.write(common.table(spark, sf_dir, "pages"), where, roll_bytes=8 << 20, shard_bytes=32 << 20)
    return warc.read(spark, where, manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
hashed AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS d FROM p),
lasts AS (SELECT n, d, max(page_id) AS last FROM hashed GROUP BY n, d),
bits AS (SELECT d, list_aggregate(list_transform(range(0, 40), lambda i: lpad(bin(CAST('0x' || substr(d, i + 1, 1) AS INTEGER)), 4, '0')), 'string_agg', '') AS b FROM (SELECT DISTINCT d FROM hashed)),
coded AS (SELECT d, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + 16 * CAST(substr(b, 5 * i + 1, 1) AS INTEGER) + 8 * CAST(substr(b, 5 * i + 2, 1) AS INTEGER) + 4 * CAST(substr(b, 5 * i + 3, 1) AS INTEGER)
  + 2 * CAST(substr(b, 5 * i + 4, 1) AS INTEGER) + CAST(substr(b, 5 * i + 5, 1) AS INTEGER), 1)), 'string_agg', '') AS c FROM bits)
SELECT h.page_id, CAST(h.n AS BIGINT) AS payload_bytes, c.c AS payload_digest, CASE WHEN h.page_id = l.last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN h.page_id <> l.last THEN l.last END AS refers_to
FROM hashed h JOIN lasts l USING (n, d) JOIN coded c ON h.d = c.d
"""


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(common.table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=512)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = hdlang.learn(docs.where(~hdlang.held_out()))
    return hdlang.predict(docs, model, keep=[F.col("doc_id"), F.coalesce(hdlang.held_out(), F.lit(False)).alias("held_out")])


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.without_repeats(common.table(spark, sf_dir, "documents"), length=100))


OP8_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS p FROM d WHERE len(h) >= 200)),
firsts AS (SELECT s, min((doc_id, p)) AS f FROM windows GROUP BY s HAVING count(*) > 1),
late AS (SELECT w.doc_id, w.p FROM windows w JOIN firsts USING (s) WHERE (w.doc_id, w.p) <> firsts.f),
marked AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS fresh FROM late),
numbered AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM marked),
spans AS (SELECT doc_id, span, min(p) AS a, max(p) + 100 AS b FROM numbered GROUP BY doc_id, span),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS g, a AS e FROM spans UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * g + 1, 2 * (coalesce(e, len(h) // 2) - g)), '' ORDER BY g) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
counted AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(c.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.k, d.h))) AS kept_sha256
FROM d LEFT JOIN counted c USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(common.table(spark, sf_dir, "documents"), shingle_words=4, max_bits=4)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), window=10)
    return decontaminate.report(found)


OP10_SQL = r"""
WITH words AS (
  SELECT 0 AS kind, CAST(doc_id AS VARCHAR) AS id, doc_id, text FROM documents
  UNION ALL SELECT 1, CAST(item_id AS VARCHAR), NULL, text FROM benchmark
), split AS (
  SELECT kind, id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM words
), asked AS (
  SELECT DISTINCT id, list_slice(w, k, k + 9) AS win
  FROM (SELECT id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS k FROM split WHERE kind = 1 AND len(w) > 0)
), sizes AS (SELECT DISTINCT len(win) AS n FROM asked),
runs AS (
  SELECT doc_id, k, n, list_slice(w, k, k + n - 1) AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM split, sizes WHERE kind = 0 AND len(w) >= n)
), found AS (SELECT r.doc_id, r.k, r.n, a.id FROM runs r JOIN asked a ON r.win = a.win),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM found) GROUP BY doc_id
), named AS (SELECT doc_id, list_sort(list(DISTINCT id)) AS ids FROM found GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(len(m.ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(m.ids, ','), '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AS contaminated
FROM split s LEFT JOIN hit h USING (doc_id) LEFT JOIN named m USING (doc_id) WHERE s.kind = 0
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_html_extraction": op2_html_extraction,
    "op3_url_filters": op3_url_filters,
    "op4_quality_rules": op4_quality_rules,
    "op5_warc": op5_warc,
    "op6_token_counts": op6_token_counts,
    "op7_language_id": op7_language_id,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_simhash": op9_simhash,
    "op10_decontamination": op10_decontamination,
}
ORACLE: dict[str, str] = {"op3_url_filters": OP3_SQL, "op5_warc": OP5_SQL, "op8_suffix_dedup": OP8_SQL, "op10_decontamination": OP10_SQL}
