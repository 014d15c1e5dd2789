"""Chart datasets: the numbers behind histograms, bar charts, box plots and error bars.

Figures themselves are not drawn; each function returns the small table a plotting
tool would read. Bin edges, quartiles and fences come from aggregates and reach the
rows either as a scalar subquery (global range) or through a size-checked broadcast
of a per-group table, never through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from strata.operators.joins import join_small
from strata.operators.selection import range_percentiles
from strata.operators.metrics import unpivot


def _bin_index(x, lo, hi, bins: int):
    """Equal-width bin of ``x`` in [lo, hi]; the last bin is closed; hi == lo -> bin 0."""
    span = hi - lo
    raw = F.floor((x - lo) * F.lit(bins) / span).cast("int")
    return F.when(span > 0, F.least(raw, F.lit(bins - 1))).otherwise(F.lit(0))


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram over the column's own range: ``(bin, bin_lo, bin_hi, count)``,
    empty bins included, NULL values left out. The range is one scalar subquery."""
    src = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double")))
    rng = src.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))
    bounds = rng.select(F.struct("lo", "hi")).scalar()  # one subquery, referenced twice
    lo, hi = bounds.getField("lo"), bounds.getField("hi")
    counts = (src.select(_bin_index(F.col(col).cast("double"), lo, hi, bins).alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    frame = rng.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    frame = frame.select("bin", (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                         (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"))
    return (frame.join(counts, "bin", "left").na.fill(0, subset=["count"])
            .orderBy("bin"))


def histogram_by_group(df: DataFrame, col: str, group: str, bins: int = 30,
                       groups_bound: int | None = None) -> DataFrame:
    """Histogram per group, each over the group's own range:
    ``(group, bin, bin_lo, bin_hi, count)`` with empty bins. Groups with a NULL key
    are left out. Per-group ranges are a table of one row per group, joined back
    after a size check."""
    src = df.where(F.col(col).isNotNull() & F.col(group).isNotNull())
    rng = src.groupBy(group).agg(F.min(col).cast("double").alias("lo"),
                                 F.max(col).cast("double").alias("hi"))
    rows = join_small(src.select(group, F.col(col).cast("double").alias("x")), rng, [group],
                      proven_rows=groups_bound)
    counts = (rows.select(group, "lo", "hi", _bin_index(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin"))
              .groupBy(group, "bin").agg(F.count(F.lit(1)).alias("count"), F.first("lo").alias("lo"),
                                         F.first("hi").alias("hi")))
    # per group: the non-empty bins as a map (at most ``bins`` entries), then every bin
    per = counts.groupBy(group).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"),
                                    F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("m"))
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    frame = per.select(group, "lo", "hi", "m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return (frame.select(group, "bin", (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                         (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
                         F.coalesce(F.col("m")[F.col("bin")], F.lit(0)).cast("bigint").alias("count"))
            .orderBy(group, "bin"))


def ordered_counts(df: DataFrame, col: str, order: Sequence[str], share_of: str = "all",
                   digits: int | None = 1) -> DataFrame:
    """Counts of a label in a fixed category order, categories without rows kept with
    count 0: ``(label, ord, count, pct)``; ``pct`` is over all rows (``'all'``) or
    over the listed categories (``'listed'``).

    One global aggregate of conditional counts (partial on every task) gives the whole
    table in one row, which is stacked into one row per category: one pass, no join."""
    c = F.col(col)
    one = df.agg(*[F.count(F.when(c == F.lit(v), F.lit(1))).alias(f"_c{i}") for i, v in enumerate(order)],
                 F.count(F.lit(1)).alias("_all"))
    listed = sum((F.col(f"_c{i}") for i in range(len(order))), F.lit(0))
    one = one.withColumn("_den", F.col("_all") if share_of == "all" else listed)
    entries = ", ".join(f"'{v}', {i + 1}, _c{i}" for i, v in enumerate(order))
    out = one.selectExpr(f"stack({len(order)}, {entries}) AS (label, ord, count)", "_den")
    p = F.lit(100.0) * F.col("count") / F.col("_den")
    if digits is not None:
        p = F.round(p, digits)
    return out.select("label", F.col("ord").cast("int").alias("ord"), F.col("count").cast("bigint").alias("count"),
                      p.alias("pct")).orderBy("ord")


def box_stats(df: DataFrame, variables: Sequence[str], group: str, whisker: float = 1.5,
              digits: int | None = None, method: str = "histogram",
              groups_bound: int | None = None) -> DataFrame:
    """Box-plot numbers per (variable, group): quartiles (linear interpolation), whiskers
    at the furthest points inside ``whisker``·IQR of the box, and the outlier count.
    ``method``: ``'histogram'`` (exact and spread over tasks, one pass), ``'range'`` (exact by range
    refinement: no table of distinct values, for continuous columns), ``'exact'`` (Spark ``percentile``:
    one value map per group, only for scores with few values), ``'approx'``
    (``percentile_approx``).

    One pass over the stacked long form computes the quartiles; the per-(variable,
    group) quartile table (bounded by variables x groups) is joined back to place the
    fences, then one more aggregate finds the whiskers and counts outliers.
    """
    long = unpivot(df.where(F.col(group).isNotNull()), variables, keep=[group]).where(F.col("value").isNotNull())
    if method == "histogram":
        # exact and in one pass over the rows: the (variable, group, value) histogram is
        # written once; quartiles, whiskers and outlier counts all come from it
        from strata.operators.joins import materialize
        from strata.operators.windows import histogram_percentiles
        hist = materialize(long.groupBy("variable", group, "value").agg(F.count(F.lit(1)).alias("c")), "hist")
        quart = histogram_percentiles(hist, "value", ["variable", group], [0.25, 0.5, 0.75], counts="c")
        quart = quart.select("variable", group, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
                             F.col("q")[2].alias("q3"))
        iqr = F.col("q3") - F.col("q1")
        quart = quart.withColumns({"lo_fence": F.col("q1") - F.lit(whisker) * iqr,
                                   "hi_fence": F.col("q3") + F.lit(whisker) * iqr})
        rows = join_small(hist, quart, ["variable", group],
                          proven_rows=None if groups_bound is None else groups_bound * len(variables))
        inside = F.col("value").between(F.col("lo_fence"), F.col("hi_fence"))
        out = rows.groupBy("variable", group).agg(
            F.first("n").cast("bigint").alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"),
            F.first("q3").alias("q3"),
            F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_hi"),
            F.sum(F.when(~inside, F.col("c")).otherwise(F.lit(0))).cast("bigint").alias("n_outliers"))
        if digits is not None:
            out = out.select(*[F.round(c, digits).alias(c) if c in ("q1", "median", "q3", "whisker_lo",
                                                                    "whisker_hi") else c for c in out.columns])
        return out.orderBy("variable", group)
    if method == "range":
        quart = range_percentiles(long, "value", ["variable", group], [0.25, 0.5, 0.75])
    else:
        q = (F.percentile("value", [0.25, 0.5, 0.75]) if method == "exact"
             else F.percentile_approx("value", [0.25, 0.5, 0.75], 10000).cast("array<double>"))
        quart = long.groupBy("variable", group).agg(F.count(F.lit(1)).alias("n"), q.alias("q"))
    quart = quart.select("variable", group, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
                         F.col("q")[2].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    quart = quart.withColumns({"lo_fence": F.col("q1") - F.lit(whisker) * iqr,
                               "hi_fence": F.col("q3") + F.lit(whisker) * iqr})
    bound = None if groups_bound is None else groups_bound * len(variables)
    # the quartile table rides along the broadcast join, so it is read once
    rows = join_small(long, quart.select("variable", group, "n", "q1", "median", "q3", "lo_fence", "hi_fence"),
                      ["variable", group], proven_rows=bound)
    inside = F.col("value").between(F.col("lo_fence"), F.col("hi_fence"))
    out = rows.groupBy("variable", group).agg(
        F.first("n").cast("bigint").alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_hi"),
        F.count(F.when(~inside, F.lit(1))).cast("bigint").alias("n_outliers"))
    if digits is not None:
        out = out.select(*[F.round(c, digits).alias(c) if c in ("q1", "median", "q3", "whisker_lo", "whisker_hi")
                           else c for c in out.columns])
    return out.orderBy("variable", group)


def box_outliers(df: DataFrame, variable: str, group: str, id_col: str, whisker: float = 1.5) -> DataFrame:
    """The outlier points themselves for one variable: ``(id, group, value)``."""
    from strata.operators.windows import histogram_percentiles
    src = df.where(F.col(group).isNotNull() & F.col(variable).isNotNull())
    quart = histogram_percentiles(src, variable, [group], [0.25, 0.75])
    iqr = F.col("q")[1] - F.col("q")[0]
    quart = quart.select(group, (F.col("q")[0] - whisker * iqr).alias("lo_fence"),
                         (F.col("q")[1] + whisker * iqr).alias("hi_fence"))
    rows = join_small(src.select(id_col, group, F.col(variable).cast("double").alias("value")), quart, [group])
    return (rows.where(~F.col("value").between(F.col("lo_fence"), F.col("hi_fence")))
            .select(id_col, group, "value"))


def mean_sd(df: DataFrame, metrics: Sequence[str], group: str, order: Sequence[str] | None = None,
            digits: int | None = 6) -> DataFrame:
    """Mean and sample sd of each metric per group (error-bar data), long form
    ``(group, metric, mean, sd, n)``, in the given group order."""
    long = unpivot(df.where(F.col(group).isNotNull()), metrics, keep=[group])
    out = long.groupBy(group, F.col("variable").alias("metric")).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
        F.count("value").alias("n"))
    if digits is not None:
        out = out.withColumn("mean", F.round("mean", digits)).withColumn("sd", F.round("sd", digits))
    if order:
        from strata.functions.labels import order_key
        return out.orderBy(order_key(group, order, rest=len(order) + 1), "metric")
    return out.orderBy(group, "metric")


def density_grid(df: DataFrame, col: str, group: str, grid: int = 100, cut: float = 2.0,
                 bw_adjust: float = 1.0, reach: float | None = None, digits: int | None = 6,
                 groups_bound: int | None = None) -> DataFrame:
    """Gaussian kernel density per group on an even grid (violin data):
    ``(group, i, x, density)``.

    Bandwidth is Scott's rule, ``sd * n^(-1/5) * bw_adjust``; the grid runs from
    ``min - cut*h`` to ``max + cut*h``. The sum runs over the (group, value, count)
    histogram; each histogram row adds to every grid point, generated per row by
    ``sequence``/``explode``: no join of rows with rows. ``reach`` leaves out the terms beyond
    that many bandwidths (each below exp(-reach^2 / 2) of the peak). A group without a
    bandwidth (one row, or one value) has one row: ``i`` 0, its value, and a NULL density.
    """
    from strata.operators.joins import materialize
    src = df.where(F.col(col).isNotNull() & F.col(group).isNotNull()).select(
        group, F.col(col).cast("double").alias("x"))
    # one pass over the rows: the (group, value) histogram, written once; n, range and
    # sd come from it (centred second pass over the small table, for stability)
    hist = materialize(src.groupBy(group, "x").agg(F.count(F.lit(1)).alias("c")), "hist")
    m = hist.groupBy(group).agg(F.sum("c").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"),
                                (F.sum(F.col("c") * F.col("x")) / F.sum("c")).alias("mean"))
    dev = join_small(hist, m.select(group, "mean"), [group], proven_rows=groups_bound)
    ss = dev.groupBy(group).agg(F.sum(F.col("c") * (F.col("x") - F.col("mean")) ** 2).alias("ss"))
    st = m.join(ss, group).withColumn("sd", F.sqrt(F.col("ss") / F.nullif(F.col("n") - 1, F.lit(0))))
    st = st.withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)) * F.lit(bw_adjust))
    flat = st.where(F.col("h").isNull() | (F.col("h") <= 0)).select(
        group, F.lit(0).alias("i"), F.col("lo").alias("x"), F.lit(None).cast("double").alias("density"))
    st = st.where(F.col("h") > 0).withColumns({
        "g0": F.col("lo") - F.lit(cut) * F.col("h"),
        "step": (F.col("hi") - F.col("lo") + F.lit(2 * cut) * F.col("h")) / F.lit(grid - 1)})
    rows = join_small(hist, st.select(group, "n", "h", "g0", "step"), [group], proven_rows=groups_bound)
    first, last = F.lit(0), F.lit(grid - 1)
    if reach is not None:
        first = F.greatest(F.ceil((F.col("x") - F.lit(reach) * F.col("h") - F.col("g0")) / F.col("step")), first)
        last = F.least(F.floor((F.col("x") + F.lit(reach) * F.col("h") - F.col("g0")) / F.col("step")), last)
    pts = rows.select(group, "x", "c", "n", "h", "g0", "step",
                      F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("i"))
    gx = F.col("g0") + F.col("i") * F.col("step")
    z = (gx - F.col("x")) / F.col("h")
    contrib = F.col("c") * F.exp(F.lit(-0.5) * z * z)
    dens = pts.groupBy(group, "i").agg(F.sum(contrib).alias("s"), F.first("n").alias("n"),
                                       F.first("h").alias("h"), F.first("g0").alias("g0"),
                                       F.first("step").alias("step"))
    x = F.col("g0") + F.col("i") * F.col("step")
    d = F.col("s") / (F.col("n") * F.col("h") * F.lit(2.5066282746310002))
    out = dens.select(group, F.col("i").cast("int").alias("i"), x.alias("x"), d.alias("density")).unionByName(flat)
    if digits is not None:
        out = out.withColumn("x", F.round("x", digits)).withColumn("density", F.round("density", digits))
    return out.orderBy(group, "i")
