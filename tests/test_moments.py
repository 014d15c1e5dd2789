import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import logistic as LG
from strata.operators import moments as MO


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 4)) * [1, 10, 1e-3, 1] + [0, 1e6, 5, 0]
    x[:, 3] = 2.0
    x[::7, 0], x[::5, 1] = np.nan, np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "id long, a double, b double, c double, d double")


@pytest.mark.parametrize("parts", [1, 13])
def test_moments_with_pairwise_gaps(data, parts):
    x, df = data
    m = MO.column_moments(df.repartition(parts), ["a", "b", "c", "d"])
    for i in range(4):
        for j in range(4):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            p, q = x[both, i], x[both, j]
            assert m.n[i, j] == both.sum() and m.mean[i, j] == pytest.approx(p.mean(), rel=1e-12, abs=1e-12)
            assert m.square[i, j] == pytest.approx(((p - p.mean()) ** 2).sum(), rel=1e-8, abs=1e-12)
            assert m.product[i, j] == pytest.approx(((p - p.mean()) * (q - q.mean())).sum(), rel=1e-7, abs=1e-9)
            if i != j and 3 not in (i, j):
                assert MO.correlation(m)[i, j] == pytest.approx(np.corrcoef(p, q)[0, 1], abs=1e-9)
    assert np.isnan(MO.correlation(m)[0, 3])


def test_merge_in_any_order(data):
    x, _ = data
    whole = MO.Moments.of(x)
    parts = [MO.Moments.of(p) for p in np.array_split(x, 9)]
    for order in (parts, parts[::-1]):
        out = order[0]
        for p in order[1:]:
            out = out.merge(p)
        assert np.allclose(out.square, whole.square, rtol=1e-8) and np.allclose(out.product, whole.product, rtol=1e-6, atol=1e-6)


def test_all_missing_and_empty(spark, data):
    df = data[1]
    assert MO.column_moments(df.limit(0), ["a"]) is None
    m = MO.column_moments(df.withColumn("z", F.lit(None).cast("double")), ["a", "z"])
    assert m.n[0, 1] == 0 and m.n[1, 1] == 0 and np.isnan(MO.correlation(m)[0, 1])


def test_logistic_gradient_vanishes(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 3)) * [1, 5, 0.1]
    y = (x[:, 0] + x[:, 1] / 5 + rng.normal(size=1500) > 0).astype(int) + (x[:, 2] > 0.1)
    df = spark.createDataFrame([(i, int(l), *map(float, r)) for i, (l, r) in enumerate(zip(y, x))],
                               "id long, label int, a double, b double, c double").repartition(5)
    model = LG.fit_logistic(df, ["a", "b", "c"], 3)
    z = np.column_stack([(x - x.mean(axis=0)) / x.std(axis=0), np.ones(len(x))])
    e = np.exp(z @ model.weights.T)
    p = e / e.sum(axis=1, keepdims=True)
    grad = (p - np.eye(3)[y]).T @ z + np.column_stack([model.weights[:, :3], np.zeros(3)])
    assert np.abs(grad).max() < 1e-6
    got = {r["id"]: r["prediction"] for r in LG.logistic_scores(df, model).collect()}
    assert [got[i] for i in range(1500)] == p.argmax(axis=1).tolist()


def test_logistic_with_a_constant_feature_and_a_missing_class(spark):
    df = spark.createDataFrame([(i, i % 2, float(i % 2) + i / 100, 3.0) for i in range(100)], "id long, label int, a double, b double")
    model = LG.fit_logistic(df, ["a", "b"], 3)
    assert np.isfinite(model.weights).all() and np.abs(model.gradient).max() < 1e-4
    assert LG.logistic_scores(df, model).where("prediction = 2").count() == 0
