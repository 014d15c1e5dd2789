"""Aggregation building blocks: prevalence, shares, conditional means, cross-tabs,
frequency tables, descriptions, correlations.

Every function is lazy and returns a DataFrame. Grouped work is a hash aggregate with
map-side partial aggregation, so a hot group (one key holding a third of the rows)
is pre-reduced on every task before the shuffle and never lands whole on one task.
Windows here only ever run over an already aggregated table (one row per group).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F

from strata.functions.scores import flag, pct


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- scalar aggregate expressions -------------------------------------------------

def count_if(cond: Column) -> Column:
    """``SUM(CASE WHEN cond THEN 1 ELSE 0 END)`` (bigint)."""
    return F.sum(flag(cond)).cast("bigint")


def rate_pct(cond: Column, digits: int | None = 1) -> Column:
    """``ROUND(100.0 * SUM(CASE WHEN cond ...) / COUNT(*), digits)``."""
    v = F.lit(100.0) * F.sum(flag(cond)) / F.count(F.lit(1))
    return v if digits is None else F.round(v, digits)


def mean_pct(col, digits: int = 1) -> Column:
    """``ROUND(100.0 * AVG(col), digits)`` for a 0/1 column."""
    return F.round(F.lit(100.0) * F.avg(_c(col)), digits)


def rmean(col, digits: int = 2) -> Column:
    return F.round(F.avg(_c(col)), digits)


def cond_mean(value, cond: Column) -> Column:
    """``AVG(CASE WHEN cond THEN value END)``: rows failing ``cond`` are ignored."""
    return F.avg(F.when(cond, _c(value)))


# --- table-level helpers on aggregated results ----------------------------------

def share(df: DataFrame, count_col: str, within: Sequence[str] = (), name: str = "share_pct",
          digits: int | None = 1) -> DataFrame:
    """Percent of ``count_col`` over its total (within groups ``within``).

    Meant for aggregated tables: with no ``within`` the window is unpartitioned and
    so runs on one task, which is harmless only for one row per group.
    """
    w = Window.partitionBy(*within) if within else Window.partitionBy()
    return df.withColumn(name, pct(F.col(count_col), F.sum(count_col).over(w), digits))


def prevalence(df: DataFrame, by: Sequence[str], positive: Column, digits: int = 1,
               count_name: str = "total", pos_name: str = "positive_count",
               pct_name: str = "prevalence_pct") -> DataFrame:
    """Rows, positives and percent positive per group (NULL keys form their own group)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(count_name),
                               count_if(positive).alias(pos_name),
                               rate_pct(positive, digits).alias(pct_name))


def value_counts(df: DataFrame, col: str, normalize_over: str = "non_null",
                 digits: int | None = None) -> DataFrame:
    """Frequency table with share: ``(value, count, share_pct)``, count-descending.

    NULL values are dropped (as ``value_counts`` does). ``normalize_over='non_null'``
    divides by the non-null total, ``'all'`` by all rows (count / len).
    """
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    # the denominator is one scalar subquery, not a window: the count table of a
    # high-cardinality column must not be gathered on one task
    if normalize_over == "all":
        total = df.agg(F.count(F.lit(1))).scalar()
    else:
        total = df.agg(F.count(col)).scalar()
    counts = counts.where(F.col("value").isNotNull())
    counts = counts.withColumn("share_pct", pct("count", total, digits))
    return counts.orderBy(F.desc("count"), F.asc("value"))


def mode_value(df: DataFrame, col: str, where: Column | None = None) -> DataFrame:
    """Most frequent non-null value and its count (ties: smallest value).

    Two aggregates: counts per value (partial aggregation), then one global ``min``
    over ``(-count, value)`` structs. No sort and no limit are needed."""
    src = df if where is None else df.where(where)
    counts = (src.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value"))
              .agg(F.count(F.lit(1)).alias("count")))
    top = counts.agg(F.min(F.struct((-F.col("count")).alias("neg"), F.col("value"))).alias("_m"))
    return top.select(F.col("_m.value").alias("value"), (-F.col("_m.neg")).alias("count"))


def crosstab(df: DataFrame, row: str, col: str, col_values: Sequence, fill: int = 0,
             drop_null_rows: bool = True) -> DataFrame:
    """Counts of ``row`` x ``col`` with one column per listed value, zeros filled.

    Long-form counts are aggregated first (partial aggregation on every task); the
    pivot then runs on that small table with an explicit value list, so no extra job
    is spent discovering values and empty categories still get a column.
    """
    src = df.where(F.col(row).isNotNull()) if drop_null_rows else df
    src = src.where(F.col(col).isNotNull())
    long = src.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    wide = long.groupBy(row).pivot(col, list(col_values)).agg(F.first("n"))
    return wide.na.fill(fill, subset=[str(v) for v in col_values])


def crosstab_ordered(df: DataFrame, row: str, row_values: Sequence, col: str, col_values: Sequence) -> DataFrame:
    """Counts of ``row`` x ``col`` for fixed category lists on both sides, every listed
    row present (zeros included) in list order: one global aggregate of conditional
    counts, stacked into one row per row category (one pass, no join)."""
    r, c = F.col(row), F.col(col)
    cells = [(i, j) for i in range(len(row_values)) for j in range(len(col_values))]
    one = df.agg(*[F.count(F.when((r == F.lit(row_values[i])) & (c == F.lit(col_values[j])), F.lit(1)))
                   .alias(f"_c{i}_{j}") for i, j in cells])
    entries = ", ".join(f"{i}, '{row_values[i]}', " + ", ".join(f"_c{i}_{j}" for j in range(len(col_values)))
                        for i in range(len(row_values)))
    names = ", ".join(f"`{v}`" for v in col_values)
    out = one.selectExpr(f"stack({len(row_values)}, {entries}) AS (_ord, `{row}`, {names})")
    return out.orderBy("_ord").drop("_ord")


def crosstab_row_pct(df: DataFrame, row: str, col: str, col_values: Sequence,
                     digits: int | None = 2) -> DataFrame:
    """Row-percent cross-tab: each cell over its row total, in percent."""
    long = (df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
            .groupBy(row, col).agg(F.count(F.lit(1)).alias("n")))
    long = share(long, "n", within=[row], name="p", digits=digits)
    wide = long.groupBy(row).pivot(col, list(col_values)).agg(F.first("p"))
    return wide.na.fill(0.0, subset=[str(v) for v in col_values])


def group_stats(df: DataFrame, by: Sequence[str], cols: Sequence[str],
                stats: Sequence[str] = ("mean", "std", "median"), digits: int | None = 2,
                drop_null_keys: bool = True, median_method: str = "histogram") -> DataFrame:
    """Several statistics of several columns per group in one aggregate, flat names
    ``<column>_<stat>``. ``std`` is the sample one; ``median`` is exact.

    ``median_method='histogram'`` computes the medians of all columns from their stacked value
    histograms (exact, spread over tasks); ``'exact'`` uses Spark's ``median`` (a value map per
    group: only for scores with few values)."""
    fns = {"mean": F.avg, "std": F.stddev_samp, "median": F.median, "min": F.min,
           "max": F.max, "count": F.count, "sum": F.sum}
    src = df
    if drop_null_keys:
        src = src.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in by]))
    rnd = (lambda e: e) if digits is None else (lambda e: F.round(e, digits))
    split_median = median_method == "histogram" and "median" in stats
    exprs = []
    for c in cols:
        for s in stats:
            if s == "median" and split_median:
                continue
            e = fns[s](c)
            if s not in ("count",):
                e = rnd(e.cast("double"))
            exprs.append(e.alias(f"{c}_{s}"))
    out = src.groupBy(*by).agg(*exprs)
    if not split_median:
        return out.select(*by, *[f"{c}_{s}" for c in cols for s in stats])
    from strata.operators.windows import histogram_percentiles
    med = histogram_percentiles(unpivot(src, cols, keep=by), "value", list(by) + ["variable"], [0.5])
    wide = med.groupBy(*by).pivot("variable", list(cols)).agg(F.first(F.col("q")[0]))
    wide = wide.select(*by, *[rnd(F.col(c)).alias(f"{c}_median") for c in cols])
    joined = out.join(wide, list(by), "left")  # both sides: one row per group
    return joined.select(*by, *[f"{c}_{s}" for c in cols for s in stats])


def describe(df: DataFrame, cols: Sequence[str], digits: int | None = 2) -> DataFrame:
    """Eight-number description per column (count, mean, std, min, 25%, 50%, 75%, max),
    long form ``(variable, count, mean, std, min, p25, p50, p75, max)``.

    The columns are stacked into ``(variable, value)`` so one grouped aggregate covers
    them all; quartiles are exact and interpolated.
    """
    long = unpivot(df, cols)
    r = (lambda e: e) if digits is None else (lambda e: F.round(e, digits))
    q = F.percentile("value", [0.25, 0.5, 0.75])
    out = long.groupBy("variable").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        q.alias("_q"), F.max("value").alias("max"))
    return out.select("variable", "count", r(F.col("mean")).alias("mean"), r(F.col("std")).alias("std"),
                      r(F.col("min")).alias("min"), r(F.col("_q")[0]).alias("p25"),
                      r(F.col("_q")[1]).alias("p50"), r(F.col("_q")[2]).alias("p75"),
                      r(F.col("max")).alias("max"))


def unpivot(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (),
            var_name: str = "variable", value_name: str = "value") -> DataFrame:
    """Long form ``(keep..., variable, value)`` of numeric columns, values as double."""
    cast = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols])
    return cast.unpivot(list(keep) if keep else [], list(cols), var_name, value_name)


def corr_long(df: DataFrame, cols: Sequence[str], digits: int | None = None,
              lower_only: bool = False, chunk_size: int = 11) -> DataFrame:
    """Pairwise Pearson correlations ``(var_x, var_y, corr)`` in one pass over the rows.

    Each pair skips rows where either side is NULL (pairwise deletion, like pandas).
    The result has ``len(cols)**2`` rows (or the strict lower triangle ``i > j`` with
    ``lower_only``); the diagonal is 1.
    """
    n = len(cols)
    # The matrix is symmetric, so each unordered pair is aggregated once. The pairs are
    # cut into chunks; every input row is stacked into one row per chunk and one
    # grouped aggregate of ``chunk_size`` correlations runs per chunk. This keeps the
    # aggregate small enough for whole-stage codegen (one wide aggregate of all pairs
    # is not) while expanding each row only ``#pairs / chunk_size`` times; the
    # expansion feeds the map-side partial aggregate and is never shuffled.
    pairs = [(i, j) for i in range(n) for j in range(i)]
    chunks = [pairs[k:k + chunk_size] for k in range(0, len(pairs), chunk_size)]
    width = max((len(c) for c in chunks), default=0)
    rows = []
    for ci, ch in enumerate(chunks):
        vals = [str(ci)]
        for s in range(width):
            if s < len(ch):
                vals += [f"CAST(`{cols[ch[s][0]]}` AS DOUBLE)", f"CAST(`{cols[ch[s][1]]}` AS DOUBLE)"]
            else:
                vals += ["CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)"]
        rows.append(", ".join(vals))
    names = ["chunk"] + [f"{a}{s}" for s in range(width) for a in ("x", "y")]
    stacked_rows = df.selectExpr(f"stack({len(chunks)}, {', '.join(rows)}) AS ({', '.join(names)})")
    per_chunk = stacked_rows.groupBy("chunk").agg(*[F.corr(f"x{s}", f"y{s}").alias(f"c{s}") for s in range(width)])
    # unpack the (at most a few) chunk rows into matrix cells: each computed pair in
    # both orientations, and the diagonal (slot -1, attached to chunk 0)
    entries = []
    for ci, ch in enumerate(chunks):
        for s, (i, j) in enumerate(ch):
            entries += [(ci, s, i, j), (ci, s, j, i)]
    entries += [(0, -1, d, d) for d in range(n)]
    entries = [e for e in entries if (e[2] > e[3] if lower_only else True)]
    slots = ", ".join(f"{a}, {b}, {c}, {d}" for a, b, c, d in entries)
    pick = F.expr(f"CASE slot WHEN -1 THEN CAST(1.0 AS DOUBLE) "
                  f"{' '.join(f'WHEN {s} THEN c{s}' for s in range(width))} END")
    cells = (per_chunk.selectExpr("*", f"stack({len(entries)}, {slots}) AS (k, slot, i, j)")
             .where("k = chunk").select("i", "j", pick.alias("corr")))
    if digits is not None:
        cells = cells.withColumn("corr", F.round("corr", digits))
    names_arr = F.array(*[F.lit(c) for c in cols])
    return cells.select(F.element_at(names_arr, F.col("i") + 1).alias("var_x"),
                        F.element_at(names_arr, F.col("j") + 1).alias("var_y"), "corr")


def corr_with_target(df: DataFrame, cols: Sequence[str], target: str,
                     digits: int | None = None) -> DataFrame:
    """Correlation of each column with ``target`` (target itself removed), descending."""
    others = [c for c in cols if c != target]
    exprs = [F.corr(c, target) for c in others]
    if digits is not None:
        exprs = [F.round(e, digits) for e in exprs]
    wide = df.agg(*[e.alias(f"c{i}") for i, e in enumerate(exprs)])
    stacked = ", ".join(f"'{c}', c{i}" for i, c in enumerate(others))
    return (wide.selectExpr(f"stack({len(others)}, {stacked}) as (variable, corr)")
            .orderBy(F.desc_nulls_last("corr")))


def distinct_sorted(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


def profile(df: DataFrame, age_col: str = "Age") -> DataFrame:
    """Rows, columns, min/max of one column and the total count of missing cells, in
    one aggregate pass."""
    missing = reduce(add, [F.sum(F.col(c).isNull().cast("long")) for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"),
                  F.min(age_col).alias("min_age"), F.max(age_col).alias("max_age"),
                  missing.cast("bigint").alias("missing_cells"))
