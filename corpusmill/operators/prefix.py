"""Running totals over long ordered partitions without one task for each partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.operators.shared import unused

#: Blocks that a key is cut into at most; their totals are accumulated in one window.
MOST_BLOCKS = 4096
#: Where order values are sparse, blocks are bounded by quantiles, found in two steps of so many.
STEPS = 64


def running_total(df: DataFrame, keys: list[str], order: str, value: Column, name: str, width: int = 4096) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over rows of the same keys before this one, by the integer column ``order``.

    Order values are cut into blocks of ``width``, or by quantiles over all rows where that would give more than
    MOST_BLOCKS blocks (hashed ids, an id far from the others). Blocks are summed, their totals accumulated over the
    at most MOST_BLOCKS blocks of a key, and rows accumulated within their block only, so a key with a third of all
    rows still spreads over tasks. Ties of ``order`` within a key get the total before all of them. Null orders form
    a block before the others; null keys are a key. All columns of ``df`` are kept, whatever their names; one called
    ``name`` is replaced. An empty table gives an empty result.
    """
    block_c, value_c, sum_c, base_c, b_c = unused(df, "block", "value", "sum", "base", "at")
    blocked = df.withColumns({block_c: _block(df, order, width), value_c: value})
    sums = blocked.groupBy(*keys, block_c).agg(F.sum(value_c).alias(sum_c))
    ahead = W.partitionBy(*keys).orderBy(F.col(block_c).asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    held = unused(sums, *[f"key_{k}" for k in range(len(keys))])
    bases = sums.select(*[F.col(k).alias(h) for k, h in zip(keys, held, strict=True)], F.col(block_c).alias(b_c), F.coalesce(F.sum(sum_c).over(ahead), F.lit(0)).alias(base_c))
    left, right = blocked.alias("left"), bases.alias("right")
    on = F.col(f"left.{block_c}").eqNullSafe(F.col(f"right.{b_c}"))
    for k, h in zip(keys, held, strict=True):
        on = on & F.col(f"left.`{k}`").eqNullSafe(F.col(f"right.{h}"))
    joined = left.join(right, on, "left").select("left.*", base_c)
    within = W.partitionBy(*keys, block_c).orderBy(order).rangeBetween(W.unboundedPreceding, W.currentRow)
    same = W.partitionBy(*keys, block_c, order)
    total = F.col(base_c) + F.sum(value_c).over(within) - F.sum(value_c).over(same)
    return joined.withColumn(name, total).drop(block_c, value_c, base_c)


def _block(df: DataFrame, order: str, width: int) -> Column:
    """The number of a row's block: by width, or by quantiles of the order values."""
    ends = df.agg(F.min(order).alias("low"), F.max(order).alias("high")).first()
    if ends["low"] is None or (ends["high"] - ends["low"]) // width < MOST_BLOCKS:
        return F.floor(F.col(order) / width)
    shares = [k / MOST_BLOCKS for k in range(1, MOST_BLOCKS)]
    cuts = sorted(set(df.agg(F.percentile_approx(order, shares, 5 * MOST_BLOCKS).alias("q")).first()["q"]))
    steps = [cuts[k : k + STEPS] for k in range(0, len(cuts), STEPS)]
    table = F.array(*[F.array(*map(F.lit, s)) for s in steps])
    passed = lambda bounds: F.size(F.filter(bounds, lambda x: x <= F.col(order)))
    step = F.size(F.filter(F.array(*[F.lit(s[0]) for s in steps]), lambda x: x <= F.col(order)))
    inside = F.when(step > 0, passed(F.element_at(table, step))).otherwise(0)
    return F.when(F.col(order).isNotNull(), (step * (STEPS + 1) + inside).cast("long"))
