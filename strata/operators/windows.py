"""Window results that stay exact and balanced at scale.

A plain ``row_number``/``ntile``/``rank`` partitioned by a category with a handful of
values sends each category, possibly a third of all rows, to one task. The
operators here compute the same numbers in two levels:

1. the rows are cut into coarse buckets that respect the window's order (a column
   prefix, a hash prefix, an id range); a small table of counts per
   (group, bucket) gives each bucket its offset by a window over that table;
2. the offset is joined back and a local window runs per (group, bucket), which
   spreads a hot group over many tasks.

The result equals the single window exactly whenever the buckets are a monotone
function of the order (checked in the tests against the plain window). Ranks that
depend only on a score (``RANK``) and mid-ranks need only step 1, on a histogram.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strata.operators.joins import join_small, materialize

WINDOW_ROWS = 100_000  # distinct values up to which plain windows run over their counts
VALUE_BUCKETS = 128  # buckets of a group's histogram: each is a task's worth of distinct values


def _nonnull_keys(df: DataFrame, cols: Sequence[str], prefix: str) -> tuple[DataFrame, list[str]]:
    """Replace nullable key columns by (value or sentinel, is-null flag) pairs, so plain
    equi-joins and window partitions on them treat NULL as one group (like GROUP BY)
    while keeping the hash partitioning of the join usable by the window."""
    names, exprs = [], {}
    types = dict(df.dtypes)
    for i, c in enumerate(cols):
        k, z = f"{prefix}k{i}", f"{prefix}z{i}"
        sentinel = F.lit("") if types[c] == "string" else F.lit(0).cast(types[c])
        exprs[k] = F.coalesce(F.col(c), sentinel)
        exprs[z] = F.col(c).isNull()
        names += [k, z]
    return df.withColumns(exprs), names


def bucketed_prefix_sum(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[Column],
                        buckets: Sequence[Column], name: str, weight: Column | None = None,
                        exclusive: bool = False, total_name: str | None = None,
                        offset_buckets: Sequence[Column] | None = None) -> DataFrame:
    """Running sum of ``weight`` (row count if None) within ``partition_by`` in the order
    ``order_by``, as ``SUM(weight) OVER (PARTITION BY p ORDER BY o ROWS UNBOUNDED
    PRECEDING)``. ``exclusive`` leaves the row's own weight out. ``buckets`` must sort
    (ascending, NULLs last) consistently with ``order_by``.
    ``total_name`` adds the group total.

    Plan: the rows are shuffled once, on (group, bucket); the per-bucket offsets are a
    small aggregate shuffled on the same keys, so the equi-join and the local window
    share that one partitioning (no broadcast needed, no second shuffle of the rows).

    ``offset_buckets`` (coarser than ``buckets``, same order) computes the offsets of
    the count table with this same two-level method, for data so large that one
    group's count table should not sit in one task either.
    """
    depth = sum(1 for c in df.columns if c.startswith("__lvl"))
    tag = f"__l{depth}"
    bnames = [f"{tag}b{i}" for i in range(len(buckets))]
    w_expr = F.lit(1).cast("long") if weight is None else weight
    x = df.withColumns({b: e for b, e in zip(bnames, buckets)}).withColumn(f"{tag}w", w_expr)
    onames = [f"{tag}o{i}" for i in range(len(offset_buckets or []))]
    if offset_buckets:
        x = x.withColumns({o: e for o, e in zip(onames, offset_buckets)})
    x, gkeys = _nonnull_keys(x, list(partition_by), f"{tag}g")
    x, bkeys = _nonnull_keys(x, bnames, f"{tag}c")
    keys = gkeys + bkeys
    counts = x.groupBy(*keys, *onames).agg(F.sum(f"{tag}w").alias(f"{tag}bw"))
    border = []
    for i in range(len(bnames)):
        border += [F.asc(f"{tag}cz{i}"), F.asc(f"{tag}ck{i}")]  # NULL buckets last
    if offset_buckets:
        # offsets of the count table, themselves in two levels
        counts = bucketed_prefix_sum(counts.withColumn(f"__lvl{depth}", F.lit(1)), gkeys, border,
                                     [F.col(o) for o in onames], name=f"{tag}start",
                                     weight=F.col(f"{tag}bw"), exclusive=True,
                                     total_name=total_name).drop(f"__lvl{depth}", *onames)
    else:
        before = Window.partitionBy(*gkeys).orderBy(*border).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn(f"{tag}start", F.coalesce(F.sum(f"{tag}bw").over(before), F.lit(0)))
        if total_name:
            counts = counts.withColumn(total_name, F.sum(f"{tag}bw").over(Window.partitionBy(*gkeys)))
    counts = counts.drop(f"{tag}bw")
    x = x.drop(*onames)
    # pinned to a shuffled join: a runtime switch to broadcast would make the window
    # shuffle the rows a second time
    joined = x.join(counts.hint("shuffle_hash"), keys, "inner")
    local_w = (Window.partitionBy(*keys).orderBy(*order_by)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = F.row_number().over(local_w) if weight is None else F.sum(f"{tag}w").over(local_w)
    out = joined.withColumn(name, F.col(f"{tag}start") + local)
    if exclusive:
        out = out.withColumn(name, F.col(name) - F.col(f"{tag}w"))
    return out.drop(f"{tag}start", f"{tag}w", *bnames, *keys)


def exact_row_number(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[Column],
                     buckets: Sequence[Column], name: str = "row_number",
                     total_name: str | None = None,
                     offset_buckets: Sequence[Column] | None = None) -> DataFrame:
    """``ROW_NUMBER() OVER (PARTITION BY p ORDER BY o)`` in the two-level form; the order
    must be total (end it with a unique key)."""
    return bucketed_prefix_sum(df, partition_by, order_by, buckets, name, total_name=total_name,
                               offset_buckets=offset_buckets)


def bucket_target(spark, per_partition: int = 64) -> int:
    """How many buckets a two-level window should use: ``per_partition`` per shuffle
    partition. ``spark.sql.shuffle.partitions`` is what a cluster scales with the data
    (e.g. thousands for 100 TB), so each (group, bucket) window stays a small slice of
    one partition's rows at any size, without running a job to count rows."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, parts * per_partition)


def hash_prefix_for(buckets: int, minimum: int = 3, maximum: int = 8) -> int:
    """Hex digits of a uniform hash prefix giving at least ``buckets`` buckets."""
    import math
    return min(maximum, max(minimum, math.ceil(math.log(max(buckets, 2), 16))))


def value_bucketed(hist: DataFrame, value: str, by: Sequence[str], n: int, name: str = "__vb") -> DataFrame:
    """Adds a bucket number 0..n-1 of ``value`` within ``by``, monotone in the value and even in
    histogram rows: the bounds are approximate quantiles of the values themselves (one bounded
    sketch per group), so one outlier or a long tail does not push the rest into one bucket.
    NULL values get a NULL bucket."""
    probs = [i / n for i in range(1, n)]
    cuts = F.percentile_approx(value, probs, 20 * n)
    if by:
        bounds = hist.groupBy(*by).agg(cuts.alias("__cuts"))
        hist = join_small(hist, bounds, list(by), null_safe=True)
    else:
        hist = hist.withColumn("__cuts", hist.select(cuts.alias("c")).scalar())
    below = F.aggregate("__cuts", F.lit(0), lambda acc, c: acc + F.when(c < F.col(value), 1).otherwise(0))
    return hist.withColumn(name, F.when(F.col(value).isNotNull(), below).cast("long")).drop("__cuts")


def position_cuts(df: DataFrame, by: Sequence[str], coarse: str, fine: str, positions) -> DataFrame:
    """The rows at given positions of each group's order, without moving the rows.

    The order is ``coarse`` (ascending, NULLs last), then ``fine`` (a unique key). ``positions`` is
    a function of the group size that gives an array of 1-based positions. Result: ``by``,
    ``cuts``: one struct (k, last, coarse, fine) per position from 1 on, k its place in the array
    and ``last`` whether ``coarse`` is NULL.

    Counts per (group, coarse) say in which coarse value each position falls; only the rows with
    those values are numbered, in two levels. Everything else is only counted."""
    counts = materialize(df.groupBy(*by, coarse).agg(F.count(F.lit(1)).alias("__c")), "counts")
    if dict(df.dtypes)[coarse] != "string" and counts.count() > WINDOW_ROWS:
        # many values: their running counts are spread over value buckets
        keyed = value_bucketed(counts, coarse, by, VALUE_BUCKETS, "__cb")
        counts = bucketed_prefix_sum(keyed, by, [F.asc_nulls_last(coarse)], [F.col("__cb")], name="__before",
                                     weight=F.col("__c"), exclusive=True, total_name="__n").drop("__cb")
    else:
        order = Window.partitionBy(*by).orderBy(F.asc_nulls_last(coarse))
        counts = (counts.withColumn("__before", F.sum("__c").over(order) - F.col("__c"))
                  .withColumn("__n", F.sum("__c").over(Window.partitionBy(*by))))
    wanted = (counts.select(*by, coarse, "__before", "__c", F.posexplode(positions(F.col("__n"))).alias("__k", "__pos"))
              .where((F.col("__pos") > F.col("__before")) & (F.col("__pos") <= F.col("__before") + F.col("__c")))
              .select(*by, coarse, "__k", (F.col("__pos") - F.col("__before")).alias("__at")))
    cells = materialize(wanted.groupBy(*by, coarse).agg(F.collect_list(F.struct("__k", "__at")).alias("__want")), "cells")
    inside = join_small(df.select(*by, coarse, fine), cells, [*by, coarse], null_safe=True)
    # a numeric key may fill a hot coarse value (a score): spread it; a hash text's range is small
    numeric = dict(df.dtypes)[fine] != "string"
    inside = value_bucketed(inside, fine, [*by, coarse], 64, "__fb") if numeric else inside.withColumn("__fb", F.lit(0))
    numbered = bucketed_prefix_sum(inside, [*by, coarse], [F.asc(fine)], [F.col("__fb")], name="__rn")
    hits = numbered.select(*by, coarse, fine, "__rn", F.explode("__want").alias("w")).where(F.col("w.__at") == F.col("__rn"))
    cut = F.struct(F.col("w.__k").alias("k"), F.col(coarse).isNull().alias("last"), F.col(coarse).alias("coarse"),
                   F.col(fine).alias("fine"))
    return materialize(hits.groupBy(*by).agg(F.sort_array(F.collect_list(cut)).alias("cuts")), "cuts")


def passed_cuts(cuts: Column, coarse: Column, fine: Column) -> Column:
    """How many of its group's cuts a row stands after (the cut row itself is not after it)."""
    def after(c: Column) -> Column:
        null, other = coarse.isNull(), c["last"]
        tie = (null & other) | (coarse == c["coarse"])
        return (null & ~other) | F.coalesce(coarse > c["coarse"], F.lit(False)) | (F.coalesce(tie, F.lit(False)) & (fine > c["fine"]))

    return F.coalesce(F.size(F.filter(cuts, after)), F.lit(0))


def ntile(df: DataFrame, k: int, partition_by: Sequence[str], score: str, id_col: str, name: str = "ntile") -> DataFrame:
    """``NTILE(k) OVER (PARTITION BY p ORDER BY score NULLS LAST, id)`` by ``k - 1`` cut rows per
    group: the rows are labelled where they are scanned and never shuffled."""
    def ends(n: Column) -> Column:
        q, r = F.floor(n / k), n % k
        return F.array(*[(F.lit(j) * q + F.least(F.lit(j), r)).cast("long") for j in range(1, k)])

    cuts = position_cuts(df, list(partition_by), score, id_col, ends)
    rows = join_small(df, cuts, list(partition_by), how="left", null_safe=True)
    return rows.withColumn(name, (passed_cuts(F.col("cuts"), F.col(score), F.col(id_col)) + 1).cast("int")).drop("cuts")


def rank_histogram(df: DataFrame, partition_by: Sequence[str], score: str,
                   descending: bool = True, name: str = "rank", value_buckets: int = VALUE_BUCKETS) -> DataFrame:
    """Histogram ``(group..., score, n)`` with the gap rank of each score in its group:
    1 + number of rows with a better score. NULL scores rank first when descending and
    last when ascending (the ordering of the analysed SQL dialect).

    The running counts over the histogram use the bucketed prefix sum over value buckets per
    group (flipped for descending order), so a continuous score with many distinct values is
    not ranked on one task per group.
    """
    hist = materialize(df.groupBy(*partition_by, score).agg(F.count(F.lit(1)).alias("n")), "hist")
    part = list(partition_by)
    hb = value_bucketed(hist, score, part, value_buckets, "__rb")
    if not part:
        hb, part = hb.withColumn("__rall", F.lit(0)), ["__rall"]
    if descending:
        hb = hb.withColumn("__rb", F.coalesce(F.lit(value_buckets) - F.col("__rb"), F.lit(-1)))
        order = [F.desc_nulls_first(score)]
    else:
        order = [F.asc_nulls_last(score)]  # a NULL score has a NULL bucket, which sorts last
    ranked = bucketed_prefix_sum(hb, part, order, [F.col("__rb")], name="__before",
                                 weight=F.col("n"), exclusive=True)
    out = ranked.withColumn(name, (F.col("__before") + 1).cast("bigint")).drop("__before", "__rb")
    return out.drop("__rall") if part == ["__rall"] else out


def rank_by_score(df: DataFrame, partition_by: Sequence[str], score: str,
                  descending: bool = True, name: str = "rank") -> DataFrame:
    """``RANK() OVER (PARTITION BY p ORDER BY score DESC)`` on every row, from the score
    histogram joined back (NULL-safe) instead of a window over the rows."""
    ranks = rank_histogram(df, partition_by, score, descending, name).drop("n")
    return join_small(df, ranks, list(partition_by) + [score], null_safe=True)


def midrank_sums(long: DataFrame, by: Sequence[str], group: str, value: str = "value",
                 value_buckets: int = VALUE_BUCKETS) -> DataFrame:
    """For each ``by`` key (e.g. variable): per group the count ``n`` and the sum of the
    mid-ranks ``rank_sum`` of its values among all non-NULL values of that key, plus the
    tie term ``sum(t^3 - t)`` over tied blocks (``ties``) and the total ``n_total``.

    Works on the value histogram only: ``(by, value, group) -> c``, ``(by, value) -> t``;
    the rows below each value come from a bucketed prefix sum over the histogram, so even a
    continuous column with many distinct values is spread over tasks. The group counts of a
    value travel as one array with it, so ranks, ties and rank sums come from one pass over
    the running counts.
    """
    src = long.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    # the one pass over the rows; every later step (bounds, running counts, mid-ranks,
    # ties, rank sums) reads this histogram, written once, instead of re-scanning
    h3 = materialize(src.groupBy(*by, value, group).agg(F.count(F.lit(1)).alias("c")), "hist")
    # a value's counts per group: at most as many entries as groups
    h2 = h3.groupBy(*by, value).agg(F.sum("c").alias("t"), F.collect_list(F.struct(F.col(group).alias("g"), "c")).alias("cs"))
    h2 = materialize(value_bucketed(h2, value, by, value_buckets), "ranked")
    below = bucketed_prefix_sum(h2, by, [F.asc(value)], [F.col("__vb")], name="below",
                                weight=F.col("t"), exclusive=True).drop("__vb")
    # mid-rank of a value = rows below + (t + 1) / 2; the tie term rides along on the first group
    mid = F.col("below") + (F.col("t") + 1) / 2.0
    parts = below.select(*by, mid.alias("mid"), (F.col("t").cast("double") ** 3 - F.col("t")).alias("tie"),
                         F.posexplode("cs").alias("pos", "s"))
    per_group = parts.groupBy(*by, F.col("s.g").alias(group)).agg(
        F.sum("s.c").alias("n"), F.sum(F.col("s.c") * F.col("mid")).alias("rank_sum"),
        F.sum(F.when(F.col("pos") == 0, F.col("tie")).otherwise(0.0)).alias("tie"))
    own = Window.partitionBy(*by)  # one row per group here
    return (per_group.withColumn("ties", F.sum("tie").over(own)).withColumn("n_total", F.sum("n").over(own)).drop("tie"))


def histogram_percentiles(df: DataFrame, value: str, by: Sequence[str], probs: Sequence[float],
                          value_buckets: int = VALUE_BUCKETS, name: str = "q",
                          counts: str | None = None) -> DataFrame:
    """Exact interpolated percentiles (``percentile_cont``) per group, computed from the
    value histogram: ``(by..., n, q)`` with ``q`` an array in the order of ``probs``.

    Spark's ``percentile`` merges a value->count map per group in one task, which is
    fine for scores with a few dozen values but not for a continuous column whose hot
    group has billions of distinct values. Here the histogram's running counts come
    from the bucketed prefix sum (spread over value buckets), each histogram row is
    tested against the two target ranks of every probability (generated per row, at
    most ``len(probs)`` rows), and only the matching rows reach the final aggregate.
    ``counts`` names a count column when ``df`` is already a histogram.
    """
    src = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if counts is not None:
        # ``df`` is already a (by..., value, counts) histogram
        hist = src.withColumnRenamed(counts, "__t")
    else:
        # one pass over the rows; bounds, running counts and probes read the written histogram
        hist = materialize(src.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__t")), "hist")
    hb = value_bucketed(hist, value, list(by), value_buckets)
    part = list(by) if by else []
    if not part:
        hb = hb.withColumn("__all", F.lit(0))
        part = ["__all"]
    ranked = bucketed_prefix_sum(hb, part, [F.asc(value)], [F.col("__vb")], name="__below",
                                 weight=F.col("__t"), exclusive=True, total_name="__n").drop("__vb")
    pos = F.col("__p") * (F.col("__n") - 1)
    lo_i, hi_i = F.floor(pos), F.ceil(pos)
    probes = ranked.select("*", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("__k", "__p"))
    inside = lambda i: (F.col("__below") <= i) & (i < F.col("__below") + F.col("__t"))
    hits = probes.where(inside(lo_i) | inside(hi_i))
    per = hits.groupBy(*part, "__k").agg(
        F.first("__n").alias("n"), F.first("__p").alias("__p"),
        F.min(F.when(inside(lo_i), F.col(value))).alias("__vlo"),
        F.max(F.when(inside(hi_i), F.col(value))).alias("__vhi"))
    pos2 = F.col("__p") * (F.col("n") - 1)
    interp = F.when(F.floor(pos2) == F.ceil(pos2), F.col("__vlo").cast("double")).otherwise(
        (F.ceil(pos2) - pos2) * F.col("__vlo") + (pos2 - F.floor(pos2)) * F.col("__vhi"))
    out = per.withColumn("__v", interp).groupBy(*part).agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("__k", "__v"))).alias("__qs"))
    out = out.select(*part, "n", F.transform("__qs", lambda s: s["__v"]).alias(name))
    return out.drop("__all") if part == ["__all"] else out
