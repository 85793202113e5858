"""Quality rules: statistics of a text as column expressions and a learned decision list over them.

Sequential covering: a rule is grown condition by condition on two thirds of the labelled sample by FOIL gain,
pruned on the other third, and kept while it is precise there; the rows it covers leave. The list is emitted as one
ordered conditional expression. Only DataFrame operations touch the documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log2

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows to learn from: those with the least hashes of their ids, at most so many.
SAMPLE_ROWS = 20_000
#: Thresholds tried for each statistic (quantiles of the sample), conditions in a rule, rules in a list.
CUTS, MOST_CONDITIONS, MOST_RULES = 40, 4, 12
#: A rule must be right on so large a part of the pruning rows it covers, and cover so many of the growing rows.
LEAST_PRECISION, LEAST_COVER = 0.9, 8

BREAK, SYMBOLS, CAPITALS = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]", "[A-ZÀ-ÖØ-Þ]"
WINDOW = 8
FEATURES = ["n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "capital_rate", "mark_rate", "distinct_rate"]


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the FEATURES.

    Null text counts as empty: no words, base_failed. Columns of these names are replaced. Words of a text are
    hashed once; windows of eight are hashes of hashes of neighbours, compared within the text only.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    step = docs.withColumn("_w", F.filter(F.split(text, BREAK), lambda w: w != ""))
    # A word with a visible character makes a line count.
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = step.withColumns({"_n": F.size("_w"), "_h": F.transform("_w", lambda w: F.xxhash64(w)), "_l": lines})
    for width in (1, 2, 4):
        step = step.withColumn("_h", F.zip_with("_h", F.slice("_h", width + 1, F.greatest(F.size("_h") - width, F.lit(0))), lambda a, b: F.xxhash64(a, b)))
    step = step.withColumn("_h", F.slice("_h", 1, F.greatest(F.col("_n") - (WINDOW - 1), F.lit(0))))
    repeated = F.size(F.array_distinct("_h")) < F.size("_h")
    step = step.withColumn("_p", F.when(repeated, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    # Places of windows that have an equal neighbour in the sorted order.
    near = lambda i, d: F.coalesce(F.get("_p", i + d)["h"], F.lit(None).cast("long"))
    step = step.withColumn("_i", F.sort_array(F.transform(F.filter("_p", lambda x, i: F.coalesce(near(i, -1) == x["h"], F.lit(False)) | F.coalesce(near(i, 1) == x["h"], F.lit(False))), lambda x: x["i"])))
    widths = F.zip_with("_i", F.slice("_i", 2, F.greatest(F.size("_i") - 1, F.lit(0))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    long = lambda c: c.cast("long")
    n, per_word = F.col("_n"), F.greatest(F.col("_n"), F.lit(1))
    own = {
        "n_words": long(n),
        "word_chars": long(F.length(F.array_join("_w", ""))),
        "n_symbols": long(F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))),
        "n_dup_lines": long(F.size("_l") - F.size(F.array_distinct("_l"))),
        "n_repeat_words": F.coalesce(F.aggregate(widths, F.lit(0).cast("long"), lambda n, x: n + x), F.lit(0).cast("long")),
        "n_lines": F.size("_l"),
        "capital_rate": 1.0 - F.length(F.regexp_replace(text, CAPITALS, "")) / F.greatest(F.length(text), F.lit(1)),
        "mark_rate": (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))) / per_word,
        "distinct_rate": F.size(F.array_distinct("_w")) / per_word,
    }
    # A generator of one row: no filter on a statistic is pushed below it, where it would be computed anew.
    kept = [c for c in docs.columns if c not in {*own, *FEATURES, "base_failed"}]
    step = step.select(*kept, F.inline(F.array(F.struct(*[c.alias(k) for k, c in own.items()]))))
    per_word = F.greatest(F.col("n_words"), F.lit(1))
    return step.withColumns({
        "mean_word": F.col("word_chars") / per_word,
        "symbol_rate": F.col("n_symbols") / per_word,
        "repeat_rate": F.col("n_repeat_words") / per_word,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    }).drop("n_lines")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        return rows[self.feature] > self.threshold if self.above else rows[self.feature] <= self.threshold

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}"


@dataclass
class DecisionList:
    """Rules that reject, in order; what none of them covers is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def kept(self) -> Column:
        verdict = F.lit(True)
        for rule in reversed(self.rules):
            test = rule[0].column()
            for c in rule[1:]:
                test = test & c.column()
            verdict = F.when(test, F.lit(False)).otherwise(verdict)
        return verdict

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, r)) for r in self.rules) + "\nkeep otherwise"


def _covers(rule: list[Condition], rows: dict[str, np.ndarray], n: int) -> np.ndarray:
    ok = np.ones(n, bool)
    for c in rule:
        ok &= c.holds(rows)
    return ok


def _grow(rows: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < MOST_CONDITIONS:
        p0, n0 = int((inside & bad).sum()), int(inside.sum())
        if p0 == 0 or p0 == n0:
            break
        base, best = log2(p0 / n0), None
        for name in FEATURES:
            x = rows[name]
            values = np.unique(x[inside])
            picked = np.unique(np.searchsorted(values, np.quantile(x[inside], np.linspace(0, 1, CUTS), method="lower")))
            # Halfway to the next value seen.
            for t in ((values[picked[picked < len(values) - 1]] + values[picked[picked < len(values) - 1] + 1]) / 2).tolist():
                for above in (True, False):
                    c = Condition(name, above, float(t))
                    now = inside & c.holds(rows)
                    p, n = int((now & bad).sum()), int(now.sum())
                    if p and n < n0:
                        offer = (p * (log2(p / n) - base), -FEATURES.index(name), above, -t)
                        if best is None or offer > best[0]:
                            best = (offer, c, now)
        if best is None or best[0][0] <= 0:
            break
        rule.append(best[1])
        inside = best[2]
    return rule


def _prune(rule: list[Condition], rows: dict[str, np.ndarray], bad: np.ndarray) -> list[Condition]:
    def worth(r: list[Condition]) -> float:
        ok = _covers(r, rows, len(bad))
        p, n = int((ok & bad).sum()), int((ok & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    options = [rule[:k] for k in range(len(rule), 0, -1)]
    return max(options, key=lambda r: (round(worth(r), 12), -len(r)))


def fit(rows: dict[str, np.ndarray], bad: np.ndarray, prune_part: np.ndarray) -> DecisionList:
    """Learn from columns of statistics; ``bad`` marks rows to reject, ``prune_part`` those kept for pruning."""
    found = DecisionList()
    live = np.ones(len(bad), bool)
    while len(found.rules) < MOST_RULES:
        g, q = live & ~prune_part, live & prune_part
        if not (bad & g).any():
            break
        at = lambda m: {k: v[m] for k, v in rows.items()}
        rule = _grow(at(g), bad[g])
        if not rule:
            break
        rule = _prune(rule, at(q), bad[q])
        ok = _covers(rule, rows, len(bad))
        p, n = int((ok & q & bad).sum()), int((ok & q).sum())
        if int((ok & g).sum()) < LEAST_COVER or n == 0 or p / n < LEAST_PRECISION:
            break
        found.rules.append(rule)
        live &= ~ok
    return found


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DecisionList:
    """A list learned from at most ``sample_rows`` labelled documents that pass the base rules.

    Label 0 is to be rejected, any other kept; null labels and ids are left out, of several labels of one id the
    least counts. Without rows of both kinds the list is empty and keeps everything.
    """
    marked = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y is not null").groupBy("_id").agg(F.min("_y").alias("_y"))
    sample = marked.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    # The sample has a bound of its own, so it may be broadcast.
    chosen = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(sample), "_id")
    part = (F.pmod(F.xxhash64(F.col("_id") + 1), F.lit(3)) == 0).alias("_part")
    got = with_statistics(chosen, "_t").where("not base_failed").select("_id", "_y", part, *[F.col(c).cast("double").alias(c) for c in FEATURES]).collect()
    got.sort(key=lambda r: (r["_id"], *[r[c] for c in FEATURES]))
    rows = {c: np.array([r[c] for r in got], float) for c in FEATURES}
    bad, part = np.array([r["_y"] == 0 for r in got], bool), np.array([r["_part"] for r in got], bool)
    return fit(rows, bad, part) if bad.any() and not bad.all() else DecisionList()


def judged(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """with_statistics() and ``kept``: false where the base rules fail, else the list's verdict."""
    return with_statistics(docs, text_col).withColumn("kept", ~F.col("base_failed") & rules.kept())
