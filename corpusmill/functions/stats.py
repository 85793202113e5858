"""Estimates, paired comparisons and verdicts as column expressions. Null is "not computable", never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of the verdicts.
Z95, CRITICAL_T, FLOOR_RATIO, CHANCE_Z = 1.96, 2.576, 1.2, 2.0
EDGES = [0, 32, 64, 128, 256, 512]


def sem(v: Column) -> Column:
    """Standard error of the mean (n - 1 in the deviation); 0 for one value."""
    return F.coalesce(F.stddev_samp(v) / F.sqrt(F.count(v)), F.when(F.count(v) > 0, F.lit(0.0)))


def paired_change(mean: Column, se: Column, lower_is_better: bool = True) -> Column:
    """better, worse or no change by the 95 % interval of a mean difference (candidate minus base)."""
    low, high = mean - Z95 * se, mean + Z95 * se
    down, up = ("better", "worse") if lower_is_better else ("worse", "better")
    return F.when(mean.isNull(), "n/a").when((low <= 0) & (high >= 0), "no change").when(mean < 0, down).otherwise(up)


def paired_t_verdict(mean: Column, sd_pop: Column, n: Column, lower_is_better: bool = True) -> Column:
    """By |mean / (population sd / sqrt n)| against CRITICAL_T; a constant offset is clear, identical runs are not."""
    t = F.when(sd_pop > 0, F.abs(mean) / (sd_pop / F.sqrt(n))).when(mean != 0, F.lit(float("inf"))).otherwise(0.0)
    down, up = ("better", "worse") if lower_is_better else ("worse", "better")
    return F.when(t <= CRITICAL_T, "not interpretable").when(mean < 0, down).otherwise(up)


def sign_test(neg: Column, pos: Column) -> Column:
    """Exact two-sided p of the lesser count among neg + pos fair signs; null for none. The tail's terms follow
    each other by C(n, k + 1) = C(n, k) (n - k) / (k + 1), in logarithms so that large n stay exact enough."""
    n, m = neg + pos, F.least(neg, pos)
    start = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))
    steps = F.when(m > 0, F.sequence(F.lit(1).cast("long"), m)).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(
        steps, start,
        lambda a, k: F.struct((a["term"] + F.log((n - k + 1) / k)).alias("term"), (a["sum"] + F.exp(a["term"] + F.log((n - k + 1) / k))).alias("sum")),
        lambda a: a["sum"],
    )
    return F.when(n > 0, F.least(F.lit(1.0), 2 * tail))


def floor_label(ratio: Column, change: Column) -> Column:
    return F.when(ratio.isNull(), "no floor").when(ratio <= FLOOR_RATIO, "NOT INTERPRETABLE").when(change == "no change", "below paired detection").otherwise(change)


def chance_verdict(score: Column, chance: Column, stderr: Column) -> Column:
    """Whether a score clears chance by CHANCE_Z standard errors."""
    no_error = F.coalesce(stderr, F.lit(0.0)) <= 0
    z = (score - chance) / F.nullif(stderr, F.lit(0.0))
    return F.when(chance.isNull(), "no baseline").when(no_error & (score == chance), "AT CHANCE").when(no_error, "no stderr").when(F.abs(z) < CHANCE_Z, "AT CHANCE").when(z > 0, "above chance").otherwise("below chance")


def bucket_of(pos: Column, edges: list[int]) -> Column:
    """Index of the half-open bucket; null outside."""
    out = F.lit(None).cast("int")
    for k in range(len(edges) - 2, -1, -1):
        out = F.when((pos >= edges[k]) & (pos < edges[k + 1]), F.lit(k)).otherwise(out)
    return out


def npmi(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """Normalised pointwise mutual information within 0 and 1; 0 for what is unseen or always together."""
    p = n_ab / n
    return F.when((n_ab > 0) & (n_ab < n), F.greatest(F.lit(0.0), F.ln(p / ((n_a / n) * (n_b / n))) / -F.ln(p))).otherwise(0.0)


def retention(value: Column, floor: Column, best: Column, best_floor: Column) -> Column:
    """The share of the best reading's room above its floor that a value keeps; 0 where there is no room."""
    room = best - best_floor
    return F.when(room > 0, (value - floor) / room).otherwise(0.0)
