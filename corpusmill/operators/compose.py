"""Corpus composition: registry, preparation, availability, blend plan, emission, splits, examples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators.prefix import running_total
from corpusmill.operators.shared import small, unused

#: Fixed value: tokens taken for a word where no tokenizer is at hand.
TOKENS_PER_WORD = 1.3
REGISTRY = "name string, slice string, target_share double, upsample int, rows_per_document int, share_alike boolean"
SLICES = ["backbone", "grounding", "spine", "folklore", "weird", "agentic", "flavour", "dialogue"]


def registry(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """The source registry; slices must be known, names distinct, shares sum to 1."""
    if unknown := {r[1] for r in rows} - set(SLICES):
        raise ValueError(f"unknown slices: {sorted(unknown)}")
    if len({r[0] for r in rows}) != len(rows):
        raise ValueError("a source is registered twice")
    if rows and abs(sum(r[2] for r in rows) - 1.0) > 1e-9:
        raise ValueError("target shares must sum to 1")
    return spark.createDataFrame(rows, REGISTRY)


def get_source(rows: list[tuple], name: str) -> tuple:
    for r in rows:
        if r[0] == name:
            return r
    raise KeyError(f"no source {name!r}; known: {', '.join(sorted(r[0] for r in rows))}")


def matches(authors: Column, shelves: Column, selector_authors: Column, selector_shelves: Column) -> Column:
    """Whether any selector is a case-folded part of its field; no selectors match nothing."""
    part = lambda field, sel: F.exists(sel, lambda s: F.contains(F.lower(F.coalesce(field, F.lit(""))), F.lower(s)))
    return part(authors, F.coalesce(selector_authors, F.array().cast("array<string>"))) | part(shelves, F.coalesce(selector_shelves, F.array().cast("array<string>")))


def cleaned(docs: DataFrame) -> DataFrame:
    """Boilerplate, then front matter, then white space: columns text, status, removed."""
    body, front = unused(docs, "body", "front")
    step = docs.withColumn(body, T.strip_boilerplate(F.col("text"))).withColumn(front, T.strip_front_matter(F.col(f"{body}.text")))
    return step.withColumns({"text": T.normalise(F.col(f"{front}.text")), "status": F.col(f"{body}.status"), "removed": F.col(f"{front}.removed")}).drop(body, front)


def grouped_documents(docs: DataFrame, rows_per_document: int) -> DataFrame:
    """(source, group_no, n_rows, text): every ``rows_per_document`` kept rows of a source, by doc_id, joined by an empty line."""
    kept = docs.where(~T.blank(F.col("text")))
    numbered = running_total(kept, ["source"], "doc_id", F.lit(1), "rank")
    group = F.floor(F.col("rank") / rows_per_document).cast("long").alias("group_no")
    parts = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    return numbered.groupBy("source", group).agg(F.count("*").alias("n_rows"), F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"))


def required(share: Column, budget: int) -> Column:
    """Tokens of a source: its share of the budget, rounded half to even."""
    return F.bround(share * budget).cast("long")


def availability(docs: DataFrame) -> DataFrame:
    counts = docs.groupBy("source").agg(F.sum(T.word_count(F.col("text"))).alias("words"))
    return counts.withColumn("tokens", F.floor(F.col("words") * TOKENS_PER_WORD).cast("long"))


def largest_budget(reg: DataFrame, available: DataFrame) -> DataFrame:
    """One row (budget): the most tokens of which every source can supply its share, 0 if one has nothing."""
    joined = reg.join(available, reg["name"] == available["source"], "left")
    can = F.coalesce("tokens", F.lit(0)) * F.col("upsample") / F.col("target_share")
    return joined.where("target_share > 0").agg(F.coalesce(F.min(can), F.lit(0.0)).alias("budget"))


def plan_blend(reg: DataFrame, available: DataFrame, budget: Column) -> DataFrame:
    """Rows (source, want, words, tokens, upsample, target): each source's tokens of the budget, and the words these
    are. A source that cannot supply them, even repeated as often as declared, is an error, and so is one that has
    words without tokens or tokens without words."""
    joined = reg.join(available, reg["name"] == available["source"], "left")
    has, words = F.coalesce("tokens", F.lit(0).cast("long")), F.coalesce("words", F.lit(0).cast("long"))
    want = F.bround(F.col("target_share") * budget).cast("long")
    short = F.concat(F.col("name"), F.lit(" cannot supply "), want.cast("string"), F.lit(" tokens"))
    empty = F.concat(F.col("name"), F.lit(" has words without tokens, or tokens without words"))
    checked = F.when(has * F.col("upsample") < want, F.raise_error(short).cast("long")).when((has > 0) != (words > 0), F.raise_error(empty).cast("long")).otherwise(want)
    plan = joined.select(F.col("name").alias("source"), checked.alias("want"), words.alias("words"), has.alias("tokens"), "upsample")
    return plan.where("want > 0").withColumn("target", F.col("want") / (F.col("tokens") / F.col("words")))


def shortfalls(reg: DataFrame, available: DataFrame, budget: int) -> DataFrame:
    """Every source with what it needs and has; needed is null where nothing is available."""
    joined = reg.join(available, reg["name"] == available["source"], "left")
    has, want = F.coalesce("tokens", F.lit(0).cast("long")), required(F.col("target_share"), budget)
    return joined.select("name", want.alias("required"), has.alias("available"), (has * F.col("upsample")).alias("achievable"), F.try_divide(want, has).alias("needed_upsample"), (has * F.col("upsample") < want).alias("short"))


def emit(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows (source, pass_no, doc_id, n_take): words to take of each document of each pass until the target is reached.

    ``docs`` has source, doc_id, n_words; ``plan`` has source, target (words, a double), words (of one pass). The
    crossing document is truncated to floor(target - words so far); passes repeat the source as a whole, and only
    passes that are needed exist.
    """
    starts = running_total(docs, ["source"], "doc_id", F.col("n_words"), "start")
    passes = plan.where("words > 0").select("source", "target", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("target") / F.col("words")).cast("int") - 1, F.lit(0)))).alias("pass_no"))
    laid = starts.join(passes, "source").withColumn("at", F.col("pass_no") * F.col("words") + F.col("start"))
    take = F.when(F.col("at") + F.col("n_words") < F.col("target"), F.col("n_words")).otherwise(F.floor(F.col("target") - F.col("at")).cast("long"))
    return laid.where(F.col("at") < F.col("target")).select("source", "pass_no", "doc_id", take.alias("n_take"))


def tail_split(df: DataFrame, keys: list[str], order: str, fraction: float) -> DataFrame:
    """``df`` with is_val: the last floor(n * fraction) rows of each key by ``order`` (ties together)."""
    n, rank, one = unused(df, "n", "rank", "one")
    if not keys:
        return tail_split(df.withColumn(one, F.lit(0)), [one], order, fraction).drop(one)
    ranked = running_total(df, keys, order, F.lit(1), rank)
    totals = df.groupBy(*[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("total"))
    left, right = ranked.alias("left"), small(totals).alias("right")
    same = reduce(lambda a, b: a & b, [F.col(f"left.`{k}`").eqNullSafe(F.col(f"right.key_{i}")) for i, k in enumerate(keys)])
    joined = left.join(right, same).select("left.*", F.col("right.total").alias(n))
    return joined.withColumn("is_val", F.col(rank) >= F.col(n) - F.floor(F.col(n) * fraction)).drop(n, rank)


def sft_example(prompt: Column, completion: Column) -> tuple[Column, Column]:
    """(input_ids, labels) padded to a multiple of 32: labels are the next tokens of the completion, else -100. An
    empty prompt is an error: the first token of the completion would have nothing that predicts it."""
    ids = F.concat(prompt, completion)
    before = F.when(F.size(prompt) < 1, F.raise_error(F.lit("an example needs a prompt")).cast("int")).otherwise(F.size(prompt) - 1)
    labels = F.concat(F.array_repeat(F.lit(-100), before), completion, F.array(F.lit(-100)))
    pad = F.pmod(-F.size(ids), F.lit(32))
    return F.concat(ids, F.array_repeat(F.lit(0), pad)), F.concat(labels, F.array_repeat(F.lit(-100), pad))


def format_share(share: Column) -> Column:
    """Percent with at most three decimals and no trailing zeros."""
    return F.concat(F.regexp_replace(F.format_string("%.3f", share * 100), r"\.?0+$", ""), F.lit("%"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
