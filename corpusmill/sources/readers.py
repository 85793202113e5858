"""Sources: tolerant and strict JSON lines, budgets, text, lexicons, prompts, nested request logs, newest artifact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators.prefix import running_total
from corpusmill.operators.shared import unused

TRAJECTORY = "step long, train_loss double, val_loss double, lr double"


def jsonl(lines: DataFrame, column: str = "value") -> DataFrame:
    """(text, status) of JSON lines: ok, empty (an object without text) or skipped (malformed, no object, text no string)."""
    # In brackets, what follows the first value makes the line malformed or a second value.
    line = F.regexp_replace(F.col(column), r"^\s+|\s+$", "")
    listed = F.try_parse_json(F.concat(F.lit("["), line, F.lit("]")))
    row = F.try_variant_get(listed, "$[0]", "variant")
    alone = line.endswith("}") & F.try_variant_get(listed, "$[1]", "variant").isNull()
    is_object = F.coalesce(alone & F.startswith(F.schema_of_variant(row), F.lit("OBJECT")), F.lit(False))
    text = F.try_variant_get(row, "$.text", "variant")
    kind = F.when(is_object, F.schema_of_variant(text))
    value = F.when(kind == "STRING", F.try_variant_get(row, "$.text", "string"))
    skipped = ~is_object | F.coalesce(~kind.isin("STRING", "VOID"), F.lit(False))
    status = F.when(skipped, "skipped").when(T.blank(value), "empty").otherwise("ok")
    return lines.select(F.when(status == "ok", value).otherwise("").alias("text"), status.alias("status"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark.read.text(path))


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """Strict: a malformed line, a missing step or loss, or an empty file is an error."""
    rows = spark.read.schema(TRAJECTORY).option("mode", "FAILFAST").json(path)
    if rows.isEmpty():
        raise ValueError(f"{path} has no rows")
    return rows.withColumn("step", F.when(F.col("step").isNull() | F.col("val_loss").isNull(), F.raise_error(F.lit("a row lacks step or val_loss"))).otherwise(F.col("step")))


def last_write_wins(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def budgeted(rows: DataFrame, order: str, limit: int) -> DataFrame:
    """The first ``limit`` rows by ``order``, counted before any filter; 0 is no limit. Ties of the last stay together."""
    if limit <= 0:
        return rows
    one, before = unused(rows, "one", "before")
    return running_total(rows.withColumn(one, F.lit(0)), [one], order, F.lit(1), before).where(F.col(before) < limit).drop(one, before)


def text_column(names: dict[str, str], repo: str) -> Column:
    if repo not in names:
        raise KeyError(f"no text column is registered for {repo}")
    return F.col(names[repo]).alias("text")


def question_answer(instruction: Column, context: Column, response: Column) -> Column:
    """Question, context and answer with empty lines between; empty if the question or the answer is."""
    body = F.concat_ws("\n\n", F.concat(F.lit("Question: "), F.trim(instruction)), F.when(~T.blank(context), F.trim(context)), F.concat(F.lit("Answer: "), F.trim(response)))
    return F.when(T.blank(instruction) | T.blank(response), "").otherwise(body)


def stories(blob: DataFrame, id_col: str, column: str, limit_before: int = 0) -> DataFrame:
    """(blob, story_no, text): stretches between separator marks, stripped; blank ones get no number."""
    parts = F.split(column, T.SEPARATOR)
    parts = F.slice(parts, 1, limit_before) if limit_before else parts
    kept = F.filter(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")
    return blob.select(id_col, F.posexplode(kept).alias("story_no", "text"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(term): lower-cased lines that are not blank and no # comments."""
    line = F.trim("value")
    return spark.read.text(path).where((line != "") & ~F.col("value").startswith("#")).select(F.lower(line).alias("term"))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(id, probe, text) of a JSON list, of an object with the list under "prompts", or of plain text: one prompt a
    line, numbered from 0, blank lines left out."""
    row = "array<struct<id:string,probe:string,text:string>>"
    whole = spark.read.text(path, wholetext=True)
    listed = F.coalesce(F.from_json("value", f"struct<prompts:{row}>")["prompts"], F.from_json("value", row))
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: ~T.blank(x))
    plain = F.transform(lines, lambda x, i: F.struct(i.cast("string").alias("id"), F.lit(None).cast("string").alias("probe"), F.trim(x).alias("text")))
    is_json = F.substring(F.ltrim("value"), 1, 1).isin("[", "{")
    return whole.select(F.inline(F.when(is_json, listed).otherwise(plain)))


def request_texts(arguments: Column) -> Column:
    """Pairs (context, continuation) of a JSON request log, an object of objects or a list of pairs; else an error."""
    objects = F.transform(F.map_values(F.from_json(arguments, "map<string,struct<arg_0:string,arg_1:string>>")), lambda x: F.struct(x["arg_0"].alias("context"), x["arg_1"].alias("continuation")))
    lists = F.transform(F.from_json(arguments, "array<array<string>>"), lambda x: F.struct(F.get(x, F.lit(0)).alias("context"), F.get(x, F.lit(1)).alias("continuation")))
    start = F.substring(F.trim(arguments), 1, 1)
    return F.when(start == "{", objects).when(start == "[", lists).otherwise(F.raise_error(F.lit("unknown form of arguments")))


def metric(metrics: Column, key: str) -> Column:
    """The first value whose "key,filter" has this key, by the order of keys."""
    hits = F.array_sort(F.filter(F.map_entries(metrics), lambda e: F.split_part(e["key"], F.lit(","), F.lit(1)) == key))
    return F.get(hits, F.lit(0))["value"]


def newest(paths: DataFrame, column: str = "path") -> DataFrame:
    """The path of the largest step number in its name (numeric, not by letter); names without one are left out."""
    step = F.regexp_extract(column, r"step[_-]?(\d+)", 1)
    return paths.where(step != "").agg(F.max_by(column, step.cast("long")).alias(column), F.max(step.cast("long")).alias("step"))


def as_float(c: Column) -> Column:
    """A number or a numeric string; anything else is null."""
    return c.try_cast("double")
