"""The two-level window operators equal the plain single-partition windows."""

import random

import pytest
from pyspark.sql import Window, functions as F

from strata.operators.windows import (bucketed_prefix_sum, exact_row_number, midrank_sums, ntile,
                                      rank_by_score, value_bucketed)


def _skewed(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        # group "hot" holds about a third of the rows; few distinct scores; some NULLs
        g = "hot" if rnd.random() < 0.34 else rnd.choice(["a", "b", "c", None])
        s = None if rnd.random() < 0.02 else rnd.randint(0, 12)
        rows.append((i * 7 + 3, g, s, rnd.random()))
    return spark.createDataFrame(rows, "id long, g string, s int, v double")


def test_exact_row_number_matches_window(spark):
    df = _skewed(spark)
    h = F.md5(F.col("id").cast("string"))
    x = df.withColumn("h", h)
    got = exact_row_number(x, ["g"], [F.asc("h"), F.asc("id")], [F.substring("h", 1, 2)], name="rn",
                           total_name="n")
    ref = x.withColumn("rn_ref", F.row_number().over(Window.partitionBy("g").orderBy("h", "id")))
    ref = ref.withColumn("n_ref", F.count(F.lit(1)).over(Window.partitionBy("g")))
    j = got.join(ref.select("id", "rn_ref", "n_ref"), "id")
    assert j.count() == df.count()
    assert j.where((F.col("rn") != F.col("rn_ref")) | (F.col("n") != F.col("n_ref"))).count() == 0


def test_ntile_matches_window_with_tiebreak(spark):
    df = _skewed(spark)
    got = ntile(df, 4, ["g"], "s", "id", name="q")
    w = Window.partitionBy("g").orderBy(F.asc_nulls_last("s"), F.asc("id"))
    ref = df.withColumn("q_ref", F.ntile(4).over(w))
    j = got.join(ref.select("id", "q_ref"), "id")
    assert j.count() == df.count()
    assert j.where(F.col("q") != F.col("q_ref")).count() == 0


def test_ntile_sizes_differ_by_at_most_one(spark):
    df = _skewed(spark, n=1001)
    got = ntile(df, 4, ["g"], "s", "id", name="q")
    sizes = got.groupBy("g", "q").count().groupBy("g").agg((F.max("count") - F.min("count")).alias("d"))
    assert sizes.where(F.col("d") > 1).count() == 0


def test_rank_by_score_matches_rank(spark):
    df = _skewed(spark)
    got = rank_by_score(df, ["g"], "s", descending=True, name="r")
    ref = df.withColumn("r_ref", F.rank().over(Window.partitionBy("g").orderBy(F.desc_nulls_first("s"))))
    j = got.join(ref.select("id", "r_ref"), "id")
    assert j.count() == df.count()
    assert j.where(F.col("r") != F.col("r_ref")).count() == 0


def test_weighted_prefix_sum_exclusive(spark):
    df = _skewed(spark, n=500)
    got = bucketed_prefix_sum(df, ["g"], [F.asc("v"), F.asc("id")], [F.floor(F.col("v") * 8)], name="p",
                              weight=F.col("id"), exclusive=True)
    w = Window.partitionBy("g").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, -1)
    ref = df.withColumn("p_ref", F.coalesce(F.sum("id").over(w), F.lit(0)))
    j = got.join(ref.select("id", "p_ref"), "id")
    assert j.where(F.col("p") != F.col("p_ref")).count() == 0


def test_midrank_sums_match_pandas(spark):
    df = _skewed(spark, n=800).where(F.col("g").isNotNull())
    long = df.select("g", F.lit("s").alias("variable"), F.col("s").cast("double").alias("value"))
    got = {r["g"]: r for r in midrank_sums(long, ["variable"], "g", "value", value_buckets=4).collect()}
    pdf = df.where(F.col("s").isNotNull()).select("g", "s").toPandas()
    pdf["r"] = pdf["s"].rank(method="average")
    exp = pdf.groupby("g")["r"].sum()
    for g, v in exp.items():
        assert abs(got[g]["rank_sum"] - v) < 1e-9
        assert got[g]["n"] == int((pdf["g"] == g).sum())
    t = pdf["s"].value_counts()
    assert abs(next(iter(got.values()))["ties"] - float((t ** 3 - t).sum())) < 1e-6


def test_result_independent_of_partitioning(spark):
    df = _skewed(spark)
    a = ntile(df.repartition(1), 4, ["g"], "s", "id", name="q").select("id", "q")
    b = ntile(df.repartition(37), 4, ["g"], "s", "id", name="q").select("id", "q")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_histogram_percentiles_match_percentile(spark):
    from strata.operators.windows import histogram_percentiles
    df = _skewed(spark, n=2000)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r for r in histogram_percentiles(df, "v", ["g"], probs, value_buckets=8).collect()}
    ref = {r["g"]: r for r in df.where(F.col("v").isNotNull()).groupBy("g").agg(
        F.count("v").alias("n"), F.percentile("v", probs).alias("q")).collect()}
    assert set(got) == set(ref)
    for g in ref:
        assert got[g]["n"] == ref[g]["n"]
        for a, b in zip(got[g]["q"], ref[g]["q"]):
            assert abs(a - b) < 1e-12
    whole = histogram_percentiles(df, "s", [], [0.5, 0.75]).collect()[0]["q"]
    exp = df.agg(F.percentile("s", [0.5, 0.75])).collect()[0][0]
    assert all(abs(a - b) < 1e-12 for a, b in zip(whole, exp))


def test_three_level_row_number(spark):
    """Offsets of the count table computed in two levels again (huge-data path)."""
    df = _skewed(spark, n=2500)
    x = df.withColumn("h", F.md5(F.col("id").cast("string")))
    got = exact_row_number(x, ["g"], [F.asc("h"), F.asc("id")], [F.substring("h", 1, 3)], name="rn",
                           total_name="n", offset_buckets=[F.substring("h", 1, 1)])
    ref = x.withColumn("rn_ref", F.row_number().over(Window.partitionBy("g").orderBy("h", "id")))
    ref = ref.withColumn("n_ref", F.count(F.lit(1)).over(Window.partitionBy("g")))
    j = got.join(ref.select("id", "rn_ref", "n_ref"), "id")
    assert j.count() == df.count()
    assert j.where((F.col("rn") != F.col("rn_ref")) | (F.col("n") != F.col("n_ref"))).count() == 0


def test_value_buckets_are_even_with_outliers_and_tails(spark):
    rows = [("x", i / 1000.0) for i in range(4000)] + [("x", 1e12)] + [("x", float(2 ** i)) for i in range(60)] + [("y", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = value_bucketed(df, "v", ["g"], 32, "b").where("v is not null")
    sizes = [r["count"] for r in got.groupBy("b").count().collect()]
    assert max(sizes) <= 3 * sum(sizes) / 32
    lows = got.groupBy("b").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(lows, lows[1:]))


def test_ntile_of_small_groups(spark):
    rows = [(g * 100 + i, f"g{g}", None if i == 0 else 5) for g in range(1, 8) for i in range(g)]
    df = spark.createDataFrame(rows, "id long, g string, s int")
    w = Window.partitionBy("g").orderBy(F.asc_nulls_last("s"), F.asc("id"))
    j = ntile(df, 4, ["g"], "s", "id", name="q").withColumn("q_ref", F.ntile(4).over(w))
    assert j.count() == len(rows) and j.where("q <> q_ref").count() == 0


def test_ntile_many_id_buckets_two_level_offsets(spark):
    df = _skewed(spark, n=1500)
    got = ntile(df, 4, ["g"], "s", "id", name="q")
    w = Window.partitionBy("g").orderBy(F.asc_nulls_last("s"), F.asc("id"))
    ref = df.withColumn("q_ref", F.ntile(4).over(w))
    j = got.join(ref.select("id", "q_ref"), "id")
    assert j.count() == df.count() and j.where(F.col("q") != F.col("q_ref")).count() == 0


def test_rank_ascending_and_continuous(spark):
    df = _skewed(spark, n=1200)
    got = rank_by_score(df, ["g"], "v", descending=False, name="r")
    ref = df.withColumn("r_ref", F.rank().over(Window.partitionBy("g").orderBy(F.asc_nulls_last("v"))))
    j = got.join(ref.select("id", "r_ref"), "id")
    assert j.count() == df.count() and j.where(F.col("r") != F.col("r_ref")).count() == 0
    got2 = rank_by_score(df, [], "s", descending=True, name="r")
    ref2 = df.withColumn("r_ref", F.rank().over(Window.orderBy(F.desc_nulls_first("s"))))
    j2 = got2.join(ref2.select("id", "r_ref"), "id")
    assert j2.count() == df.count() and j2.where(F.col("r") != F.col("r_ref")).count() == 0


@pytest.mark.parametrize("limit", [5, 10 ** 9])
def test_ntile_of_distinct_doubles_with_a_hot_group(spark, monkeypatch, limit):
    """Equal to the plain window, whether the values' counts go through buckets or one window."""
    from strata.operators import windows as W
    monkeypatch.setattr(W, "WINDOW_ROWS", limit)
    score = F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 7 == 0, 0.5).otherwise(F.xxhash64("id") / 3)
    df = spark.range(3000).select("id", F.when(F.col("id") % 20 == 0, "b").otherwise("a").alias("g"), score.alias("s"))
    plain = df.withColumn("t", F.ntile(4).over(Window.partitionBy("g").orderBy(F.asc_nulls_last("s"), "id")))
    got = W.ntile(df, 4, ["g"], "s", "id", name="t")
    assert got.select("id", "t").exceptAll(plain.select("id", "t")).isEmpty()
    assert got.count() == 3000
