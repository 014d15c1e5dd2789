"""Order statistics by range refinement against a plain sort."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators.selection import range_percentiles, values_at_ranks

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def frame(spark, groups):
    rows = [(g, None if v is None else float(v)) for g, vs in groups.items() for v in vs]
    return spark.createDataFrame(rows, "g string, v double").repartition(7)


@pytest.mark.parametrize("bins, few", [(1024, 4096), (64, 0), (16, 30)])
def test_percentiles_equal_a_sort(spark, bins, few):
    rng = np.random.default_rng(1)
    groups = {"wide": rng.lognormal(0, 3, 800), "ties": rng.integers(0, 3, 300), "one": [5.0], "same": [2.5] * 50,
              "signs": rng.normal(size=101), "tiny": [1.0, np.nextafter(1.0, 2)], None: [3, 1, 2, None, math.nan]}
    got = {r["g"]: r for r in range_percentiles(frame(spark, groups), "v", ["g"], PROBS, bins=bins, few=few).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        x = np.array([v for v in vs if v is not None and not math.isnan(v)], float)
        assert got[g]["n"] == len(x)
        assert got[g]["q"] == pytest.approx(np.quantile(x, PROBS).tolist(), rel=1e-12)


def test_huge_and_infinite_values(spark):
    vs = [-math.inf, -1.7e308, -1.0, 0.0, 1.0, 1.7e308, math.inf, math.inf]
    at = values_at_ranks(frame(spark, {"a": vs}), "v", ["g"], lambda n: F.sequence(F.lit(0).cast("long"), n - 1), bins=4, few=0)
    assert [r["v"] for r in at.orderBy("rank").collect()] == vs


def test_without_groups_and_without_rows(spark):
    df = frame(spark, {"a": range(100), "b": range(100, 201)})
    assert range_percentiles(df, "v", [], [0.5], few=10).first()["q"] == [100.0]
    assert range_percentiles(df.where("v < 0"), "v", ["g"], [0.5]).collect() == []


def test_a_hot_group_is_counted_not_gathered(spark):
    """No shuffled table grows with the number of distinct values."""
    df = spark.range(200_000).select(F.when(F.col("id") % 100 == 0, "b").otherwise("a").alias("g"), (F.xxhash64("id") / 7).alias("v"))
    got = {r["g"]: r["q"][0] for r in range_percentiles(df, "v", ["g"], [0.5], bins=64, few=100).collect()}
    x = {g: [] for g in "ab"}
    for r in df.collect():
        x[r["g"]].append(r["v"])
    assert got == {g: pytest.approx(float(np.median(v))) for g, v in x.items()}
