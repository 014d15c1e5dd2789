"""Group-comparison tests from per-group sufficient statistics.

NaN counts as missing. Where a statistic is undefined (one group, one row per group, all
values equal, an empty table) it is NULL, and so is its p-value; the verdict is then ``NO``.

No group is ever collected: ANOVA needs (n, mean, variance) per group, Kruskal-Wallis
needs the rank sum per group (from the value histogram, see ``windows.midrank_sums``),
chi-square needs the observed cells and their margins. Each test is a handful of
aggregates with partial aggregation followed by arithmetic on a tiny table; p-values
are attached by :mod:`strata.functions.pvalues` on the one-row (per variable) result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from strata.functions.pvalues import chi2_pvalue, f_pvalue
from strata.operators.metrics import unpivot
from strata.operators.windows import midrank_sums


def anova_oneway(df: DataFrame, value: str, group: str, digits: int | None = 6) -> DataFrame:
    """One-way ANOVA of ``value`` across ``group`` (NULL values and groups dropped):
    ``(k, n, df_between, df_within, ss_between, ss_within, f_stat)``."""
    src = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & F.col(group).isNotNull())
    g = src.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"),
                               F.var_samp(value).alias("v"))
    # the grand mean is a scalar subquery over the same aggregate (its exchange is reused)
    grand = g.agg((F.sum(F.col("n") * F.col("m")) / F.nullif(F.sum("n"), F.lit(0))).alias("grand")).scalar()
    g = g.withColumn("grand", grand)
    out = g.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
                F.sum(F.col("n") * (F.col("m") - F.col("grand")) ** 2).alias("ss_between"),
                F.sum(F.coalesce((F.col("n") - 1) * F.col("v"), F.lit(0.0))).alias("ss_within"))
    out = out.select(
        F.col("k").cast("bigint").alias("k"), F.col("n").cast("bigint").alias("n"),
        (F.col("k") - 1).cast("bigint").alias("df_between"),
        (F.col("n") - F.col("k")).cast("bigint").alias("df_within"),
        "ss_between", "ss_within")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    f = ratio("ss_between", "df_between") / F.nullif(ratio("ss_within", "df_within"), F.lit(0.0))
    out = out.withColumn("f_stat", f)
    if digits is not None:
        out = out.select(*[F.round(c, digits).alias(c) if c in ("ss_between", "ss_within", "f_stat") else c
                           for c in out.columns])
    return out


def with_f_pvalue(res: DataFrame, alpha: float = 0.05, digits: int | None = None) -> DataFrame:
    p = f_pvalue(F.col("f_stat"), F.col("df_between"), F.col("df_within"))
    p = p if digits is None else F.round(p, digits)
    return res.withColumn("p_value", p).withColumn(
        "significant", F.when(F.col("p_value") < alpha, "YES").otherwise("NO"))


def kruskal_wallis(df: DataFrame, variables: Sequence[str], group: str, digits: int | None = 6) -> DataFrame:
    """Kruskal-Wallis H per variable across ``group``, with the tie correction.

    All variables in one pass: stacked long ``(variable, group, value)``, mid-ranks from
    the value histogram, rank sums per group. NULL values and groups are dropped per
    variable; ``n`` reports what was used. Output ``(variable, k, n, h_stat)``.
    """
    long = unpivot(df.where(F.col(group).isNotNull()), variables, keep=[group])
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    sums = midrank_sums(long, ["variable"], group, "value")
    per_var = sums.groupBy("variable").agg(
        F.count(F.lit(1)).alias("k"), F.first("n_total").alias("n_total"), F.first("ties").alias("ties"),
        F.sum(F.col("rank_sum") ** 2 / F.col("n")).alias("s"))
    n = F.col("n_total").cast("double")
    h_raw = F.lit(12.0) / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    corr = 1 - F.col("ties") / F.nullif(n ** 3 - n, F.lit(0.0))
    h = h_raw / F.nullif(corr, F.lit(0.0))
    out = per_var.select("variable", F.col("k").cast("bigint").alias("k"),
                         F.col("n_total").cast("bigint").alias("n"), h.alias("h_stat"))
    if digits is not None:
        out = out.withColumn("h_stat", F.round("h_stat", digits))
    return out


def with_chi2_pvalue(res: DataFrame, stat: str, dof: str, alpha: float = 0.05, digits: int | None = None) -> DataFrame:
    p = chi2_pvalue(F.col(stat), F.col(dof))
    return res.withColumn("p_value", p if digits is None else F.round(p, digits)).withColumn(
        "significant", F.when(F.col("p_value") < alpha, "YES").otherwise("NO"))


def _observed_cells(df: DataFrame, row: str, col: str) -> DataFrame:
    src = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    cells = src.groupBy(row, col).agg(F.count(F.lit(1)).alias("observed"))
    # the total is a scalar subquery over the same aggregate
    total = cells.agg(F.sum("observed").alias("n")).scalar()
    cells = (cells.withColumn("row_total", F.sum("observed").over(Window.partitionBy(row)))
             .withColumn("col_total", F.sum("observed").over(Window.partitionBy(col)))
             .withColumn("n", total))
    return cells.withColumn("expected", F.col("row_total") * F.col("col_total") / F.col("n"))


def contingency_cells(df: DataFrame, row: str, col: str) -> DataFrame:
    """The whole table of two labels: ``(row, col, observed, row_total, col_total, n, expected)``,
    empty cells with 0 included; NULL labels are dropped (cross-tab rule). The table has as many
    cells as labels times labels by definition: every row label is written out over the list
    of column labels (one small array in a scalar subquery)."""
    cells = _observed_cells(df, row, col)
    per_row = cells.groupBy(row).agg(
        F.first("row_total").alias("row_total"), F.first("n").alias("n"),
        F.map_from_entries(F.collect_list(F.struct(col, "observed"))).alias("own"))
    margin = cells.groupBy(col).agg(F.first("col_total").alias("t"))
    columns = margin.agg(F.sort_array(F.collect_list(F.struct(F.col(col).alias("c"), "t"))).alias("cs")).scalar()
    out = per_row.withColumn("x", F.explode(columns))
    return out.select(row, F.col("x.c").alias(col),
                      F.coalesce(F.try_element_at("own", F.col("x.c")), F.lit(0)).alias("observed"), "row_total",
                      F.col("x.t").alias("col_total"), "n", (F.col("row_total") * F.col("x.t") / F.col("n")).alias("expected"))


def chi_square(df: DataFrame, row: str, col: str, digits: int | None = 6,
               correction: bool = True) -> DataFrame:
    """Pearson chi-square test of independence of two labels:
    ``(n, n_rows, n_cols, dof, chi2)``.

    An empty cell contributes (0 - e)^2 / e = e, and the expected counts of all cells
    sum to N, so chi2 = sum over observed cells of (o - e)^2 / e + (N - sum of their e):
    only observed cells are aggregated and no product of the margins is built.

    With ``correction`` a 2x2 table (dof 1) gets the continuity correction: every cell of
    a 2x2 table has the same |o - e| = D, so the corrected statistic is
    max(D - 1/2, 0)^2 * N * (sum of 1/row totals) * (sum of 1/column totals).
    """
    cells = _observed_cells(df, row, col)
    # cells per row / column, so that sums over cells can form sums over rows / columns
    cells = (cells.withColumn("row_cells", F.count(F.lit(1)).over(Window.partitionBy(row)))
             .withColumn("col_cells", F.count(F.lit(1)).over(Window.partitionBy(col))))
    o, e = F.col("observed").cast("double"), F.col("expected")
    out = cells.agg(
        F.coalesce(F.sum("observed"), F.lit(0)).alias("n"),
        F.countDistinct(row).alias("n_rows"), F.countDistinct(col).alias("n_cols"),
        F.sum((o - e) ** 2 / e).alias("s_obs"), F.sum(e).alias("e_obs"),
        F.max(F.abs(o - e)).alias("d"),
        F.sum(1.0 / (F.col("row_total") * F.col("row_cells"))).alias("inv_rows"),
        F.sum(1.0 / (F.col("col_total") * F.col("col_cells"))).alias("inv_cols"))
    dof = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    plain = F.col("s_obs") + (F.col("n") - F.col("e_obs"))
    yates = (F.greatest(F.col("d") - F.lit(0.5), F.lit(0.0)) ** 2 * F.col("n")
             * F.col("inv_rows") * F.col("inv_cols"))
    # under two labels on a side there is nothing to test
    stat = F.when(dof >= 1, F.when(dof == 1, yates).otherwise(plain) if correction else plain)
    out = out.select(
        F.col("n").cast("bigint").alias("n"), F.col("n_rows").cast("bigint").alias("n_rows"),
        F.col("n_cols").cast("bigint").alias("n_cols"), dof.cast("bigint").alias("dof"),
        stat.alias("chi2"))
    if digits is not None:
        out = out.withColumn("chi2", F.round("chi2", digits))
    return out
