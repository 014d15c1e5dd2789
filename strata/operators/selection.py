"""Exact order statistics by range refinement.

To find the value at a rank nothing is sorted and no table of distinct values is written: the range of
the values is cut into even bins, the rows of each bin are counted, and only the bin that holds the
rank is looked at again, between the smallest and the largest value found in it. Every pass is one
scan with partial aggregation of at most (groups x ranks x bins) rows, however many distinct values
there are and however a hot group is spread. An interval of few rows is finished from its values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strata.operators.joins import join_small, materialize

BINS = 1024     # of an interval in a pass
FEW = 4096      # rows from which on an interval is not finished from its values
LARGEST = 1.7976931348623157e308


def _bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Even bins over [lo, hi], monotone in v. Halved, so that the width of any range is finite."""
    half = lambda x: F.greatest(F.least(x, F.lit(LARGEST)), F.lit(-LARGEST)) / 2
    place = F.floor((half(v) - half(lo)) / (half(hi) - half(lo)) * bins)
    # infinite values have bins of their own
    return (F.when(v == float("-inf"), -1).when(v == float("inf"), bins)
            .otherwise(F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1)))).cast("int")


def values_at_ranks(df: DataFrame, value: str, by: Sequence[str], ranks, bins: int = BINS, few: int = FEW) -> DataFrame:
    """``by``, ``n``, ``rank``, ``v``: the values at some 0-based ranks of each group's ascending order.
    ``ranks`` is a function of the group's row count that gives an array. NULL and NaN do not count;
    NULL keys are a group."""
    keys = list(by)
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    if not keys:
        rows, keys = rows.withColumn("__all", F.lit(0)), ["__all"]
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    open_ = materialize(stats.select(*keys, "n", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("c"),
                                     F.explode(F.array_distinct(ranks(F.col("n")))).alias("rank")), "select")
    done = None
    while True:
        closed = open_.where("lo = hi").select(*keys, "n", "rank", F.col("lo").alias("v"))
        done = closed if done is None else done.unionByName(closed)
        rest = open_.where("lo < hi")
        if rest.isEmpty():
            break
        spans = rest.groupBy(*keys, "n", "lo", "hi", "below", "c").agg(F.collect_list("rank").alias("ranks"))
        inside = join_small(rows, spans, keys, null_safe=True).where((F.col("__v") >= F.col("lo")) & (F.col("__v") <= F.col("hi")))
        span = [*keys, "n", "lo", "below", "ranks"]
        small = (inside.where(F.col("c") <= few).groupBy(*span).agg(F.sort_array(F.collect_list("__v")).alias("vs"))
                 .select(*keys, "n", F.explode("ranks").alias("rank"), "vs", "below")
                 .select(*keys, "n", "rank", F.element_at("vs", (F.col("rank") - F.col("below") + 1).cast("int")).alias("v")))
        counted = (inside.where(F.col("c") > few).groupBy(*span, _bin(F.col("__v"), F.col("lo"), F.col("hi"), bins).alias("b"))
                   .agg(F.count(F.lit(1)).alias("c"), F.min("__v").alias("lo2"), F.max("__v").alias("hi2")))
        before = Window.partitionBy(*span).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # at most bins + 2 rows
        counted = counted.withColumn("below2", F.col("below") + F.coalesce(F.sum("c").over(before), F.lit(0)))
        found = (counted.select(*keys, "n", "c", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), F.col("below2").alias("below"),
                                F.explode("ranks").alias("rank"))
                 .where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("c"))))
        level = materialize(small.select(*keys, "n", "rank", F.col("v").alias("lo"), F.col("v").alias("hi"),
                                         F.lit(0).cast("long").alias("below"), F.lit(1).cast("long").alias("c"))
                            .unionByName(found.select(*keys, "n", "rank", "lo", "hi", "below", "c")), "select")
        open_ = level
    return done if by else done.drop("__all")


def range_percentiles(df: DataFrame, value: str, by: Sequence[str], probs: Sequence[float], name: str = "q",
                      bins: int = BINS, few: int = FEW) -> DataFrame:
    """``by``, ``n`` and ``name``: the exact interpolated percentiles (``percentile_cont``) of each group, an
    array in the order of ``probs``. A group without values has no row."""
    positions = [float(p) for p in probs]

    def ranks(n: Column) -> Column:
        at = [F.lit(p) * (n - 1) for p in positions]
        return F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)])

    at = values_at_ranks(df, value, by, ranks, bins, few)
    if not by:
        at = at.withColumn("__all", F.lit(0))
    keys = list(by) or ["__all"]
    both = at.groupBy(*keys, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("vs"))

    def one(p: float) -> Column:
        x = F.lit(p) * (F.col("n") - 1)
        lo, hi = F.floor(x).cast("long"), F.ceil(x).cast("long")
        a, b = F.element_at("vs", lo), F.element_at("vs", hi)
        return F.when(lo == hi, a).otherwise((hi - x) * a + (x - lo) * b)

    out = both.select(*keys, "n", F.array(*[one(p) for p in positions]).alias(name))
    return out if by else out.drop("__all")
