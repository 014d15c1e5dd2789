"""Tests, p-values and shares against hand or pandas computations."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strata.functions.pvalues import chi2_pvalue, f_pvalue
from strata.operators import metrics as M
from strata.operators import stats as ST


def _chi2(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, x double, k int")
    return [r.p for r in df.withColumn("p", chi2_pvalue(F.col("x"), F.col("k"))).orderBy("i").collect()]


def _f(spark, rows):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(rows)], "i int, f double, a int, b long")
    return [r.p for r in df.withColumn("p", f_pvalue(F.col("f"), F.col("a"), F.col("b"))).orderBy("i").collect()]


def test_pvalues_against_closed_forms(spark):
    xs = (1e-6, 0.5, 3.0, 12.0, 40.0, 900.0)
    one = _chi2(spark, [(x, 1) for x in xs])
    two = _chi2(spark, [(x, 2) for x in xs])
    six = _chi2(spark, [(x, 6) for x in xs])
    for x, a, b, c in zip(xs, one, two, six):
        assert math.isclose(a, math.erfc(math.sqrt(x / 2)), rel_tol=1e-10)
        assert math.isclose(b, math.exp(-x / 2), rel_tol=1e-10)
        assert math.isclose(c, math.exp(-x / 2) * (1 + x / 2 + x * x / 8), rel_tol=1e-10)
    # two and four degrees above: finite sums of powers of y = d2 / (d2 + d1 f)
    for f, d2 in ((0.2, 3), (1.5, 10), (5.0, 40), (30.0, 12)):
        y2, y4 = d2 / (d2 + 2 * f), d2 / (d2 + 4 * f)
        got = _f(spark, [(f, 2, d2), (f, 4, d2)])
        assert math.isclose(got[0], y2 ** (d2 / 2), rel_tol=1e-10)
        assert math.isclose(got[1], y4 ** (d2 / 2) * (1 + d2 / 2 * (1 - y4)), rel_tol=1e-10)


def test_f_tail_keeps_its_digits_for_many_rows(spark):
    limit = _chi2(spark, [(3 * 2.68, 3)])[0]
    for p, n in zip(_f(spark, [(2.68, 3, n) for n in (10 ** 8, 10 ** 12, 10 ** 14)]), (10 ** 8, 10 ** 12, 10 ** 14)):
        assert math.isclose(p, limit, rel_tol=max(30 / n, 1e-9))


def test_pvalues_of_undefined_statistics(spark):
    assert _chi2(spark, [(None, 3), (float("nan"), 3), (1.0, 0), (0.0, 3), (-1.0, 3)]) == [None, None, None, 1.0, 1.0]
    assert _f(spark, [(None, 1, 2), (float("nan"), 1, 2), (1.0, 0, 5), (1.0, 1, 0), (0.0, 1, 2)]) == [None] * 4 + [1.0]


def test_statistics_without_a_definition(spark):
    nan = float("nan")
    one_group = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", nan), ("b", None)], "g string, v double")
    r = ST.with_f_pvalue(ST.anova_oneway(one_group, "v", "g")).first()
    assert (r.k, r.n, r.df_between, r.f_stat, r.p_value, r.significant) == (1, 2, 0, None, None, "NO")
    single_rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "g string, v double")
    assert ST.anova_oneway(single_rows, "v", "g").first().f_stat is None
    assert ST.kruskal_wallis(single_rows.limit(1), ["v"], "g").first().h_stat is None
    nans = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", nan), ("b", nan)], "g string, v double")
    assert ST.kruskal_wallis(nans, ["v"], "g").first().n == 2
    none = spark.createDataFrame([], "g string, v double")
    assert ST.anova_oneway(none, "v", "g").first().n == 0
    assert ST.chi_square(single_rows.where("g = 'a'"), "g", "v").first().chi2 is None


def test_contingency_table_lists_empty_cells(spark):
    df = spark.createDataFrame([("x", "p")] * 3 + [("x", "q")] * 2 + [("y", "p")], "a string, b string")
    got = {(r.a, r.b): (r.observed, r.expected) for r in ST.contingency_cells(df, "a", "b").collect()}
    assert got == {("x", "p"): (3, 5 * 4 / 6), ("x", "q"): (2, 5 * 2 / 6), ("y", "p"): (1, 4 / 6), ("y", "q"): (0, 2 / 6)}


def _groups(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(v)) for g, mu in [("a", 1.0), ("b", 1.4), ("c", 0.8)] for v in rng.normal(mu, 1, 40).round(1)]
    return spark.createDataFrame(rows, "g string, v double"), pd.DataFrame(rows, columns=["g", "v"])


def test_anova_against_formula(spark):
    df, pdf = _groups(spark)
    res = ST.anova_oneway(df, "v", "g", digits=None).collect()[0]
    grand = pdf.v.mean()
    ssb = sum(len(x) * (x.mean() - grand) ** 2 for _, x in pdf.groupby("g").v)
    ssw = sum(((x - x.mean()) ** 2).sum() for _, x in pdf.groupby("g").v)
    f = (ssb / 2) / (ssw / (len(pdf) - 3))
    assert abs(res["f_stat"] - f) < 1e-9 and res["df_between"] == 2 and res["df_within"] == len(pdf) - 3


def test_kruskal_against_formula(spark):
    df, pdf = _groups(spark)
    res = ST.kruskal_wallis(df, ["v"], "g", digits=None).collect()[0]
    r = pdf.v.rank(method="average")
    n = len(pdf)
    h = 12 / (n * (n + 1)) * sum(r[pdf.g == g].sum() ** 2 / (pdf.g == g).sum() for g in "abc") - 3 * (n + 1)
    t = pdf.v.value_counts()
    h /= 1 - (t ** 3 - t).sum() / (n ** 3 - n)
    assert abs(res["h_stat"] - h) < 1e-9


def test_chi_square_with_empty_cell(spark):
    rows = [("x", "p")] * 10 + [("x", "q")] * 5 + [("y", "p")] * 7 + [("z", "q")] * 3
    df = spark.createDataFrame(rows, "a string, b string")
    res = ST.chi_square(df, "a", "b", digits=None).collect()[0]
    obs = pd.crosstab(pd.Series([r[0] for r in rows]), pd.Series([r[1] for r in rows])).to_numpy()
    exp = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    assert abs(res["chi2"] - ((obs - exp) ** 2 / exp).sum()) < 1e-9 and res["dof"] == 2


def test_shares_sum_to_100(spark):
    df = spark.createDataFrame([(i % 7, i % 3) for i in range(1000)], "a int, b int")
    agg = M.share(df.groupBy("a", "b").count(), "count", within=["a"], name="p", digits=1)
    sums = agg.groupBy("a").agg(F.sum("p").alias("s"), F.count("*").alias("k")).collect()
    for r in sums:
        assert abs(r["s"] - 100) <= 0.05 * r["k"] + 1e-9


def test_crosstab_zero_fill_and_corr_vs_pandas(spark):
    df = spark.createDataFrame([("m", "A"), ("m", "A"), ("f", "B")], "s string, d string")
    wide = {r["s"]: r for r in M.crosstab(df, "s", "d", ["A", "B", "C"]).collect()}
    assert (wide["m"]["A"], wide["m"]["B"], wide["m"]["C"]) == (2, 0, 0)
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(200, 3)), columns=["x", "y", "z"])
    pdf.loc[::17, "y"] = np.nan
    sdf = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None))
    got = {(r["var_x"], r["var_y"]): r["corr"] for r in M.corr_long(sdf, ["x", "y", "z"], chunk_size=2).collect()}
    exp = pdf.corr()
    for a in "xyz":
        for b in "xyz":
            assert abs(got[(a, b)] - exp.loc[a, b]) < 1e-9


def test_chi_square_yates_2x2(spark):
    # a=12, b=5, c=3, d=0 (one empty cell)
    rows = [("u", "p")] * 12 + [("u", "q")] * 5 + [("v", "p")] * 3
    df = spark.createDataFrame(rows, "a string, b string")
    res = ST.chi_square(df, "a", "b", digits=None).collect()[0]
    obs = np.array([[12.0, 5.0], [3.0, 0.0]])
    exp = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    adj = np.maximum(np.abs(obs - exp) - 0.5, 0.0)
    assert res["dof"] == 1 and abs(res["chi2"] - (adj ** 2 / exp).sum()) < 1e-9
    plain = ST.chi_square(df, "a", "b", digits=None, correction=False).collect()[0]
    assert abs(plain["chi2"] - ((obs - exp) ** 2 / exp).sum()) < 1e-9


def test_group_stats_histogram_median_equals_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(g, float(x), float(y)) for g in "abc" for x, y in rng.normal(size=(101, 2)).round(3)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    a = {r["g"]: r for r in M.group_stats(df, ["g"], ["x", "y"], digits=None).collect()}
    b = {r["g"]: r for r in M.group_stats(df, ["g"], ["x", "y"], digits=None, median_method="histogram").collect()}
    for g in a:
        for c in ("x_mean", "x_std", "x_median", "y_median"):
            assert abs(a[g][c] - b[g][c]) < 1e-12


def test_mode_and_value_counts_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "x string")
    top = M.mode_value(df, "x").collect()[0]
    assert (top["value"], top["count"]) == ("a", 2)
    vc = M.value_counts(df, "x", normalize_over="all", digits=None).collect()
    assert [r["value"] for r in vc] == ["a", "b", "c"]
    assert abs(vc[0]["share_pct"] - 100 * 2 / 6) < 1e-12
    vc2 = M.value_counts(df, "x", normalize_over="non_null", digits=None).collect()
    assert abs(vc2[0]["share_pct"] - 100 * 2 / 5) < 1e-12


def test_box_outliers_and_quantile_cut_methods(spark):
    from strata.operators.charts import box_outliers, box_stats
    from strata.operators.clean import quantile_cut
    rng = np.random.default_rng(11)
    vals = np.concatenate([rng.normal(0, 1, 300).round(2), [8.0, -7.5, 9.1]])
    pdf = pd.DataFrame({"id": range(len(vals)), "g": ["a"] * len(vals), "v": vals})
    df = spark.createDataFrame(pdf)
    q1, q3 = np.percentile(vals, [25, 75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    exp_ids = set(pdf.id[(pdf.v < lo) | (pdf.v > hi)])
    got_ids = {r["id"] for r in box_outliers(df, "v", "g", "id").collect()}
    assert got_ids == exp_ids
    st = box_stats(df, ["v"], "g").collect()[0]
    assert st["n_outliers"] == len(exp_ids)
    assert abs(st["whisker_hi"] - vals[vals <= hi].max()) < 1e-12
    a = quantile_cut(df, "v", name="c").select("id", "c")
    b = quantile_cut(df, "v", name="c", method="histogram").select("id", "c")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_box_stats_histogram_equals_exact(spark):
    from strata.operators.charts import box_stats
    rng = np.random.default_rng(2)
    rows = [(g, float(v), float(w)) for g in "ab" for v, w in rng.normal(size=(150, 2)).round(2)]
    rows += [("a", 9.0, None), ("b", None, -8.0)]
    df = spark.createDataFrame(rows, "g string, v double, w double")
    a = {(r["variable"], r["g"]): r for r in box_stats(df, ["v", "w"], "g").collect()}
    b = {(r["variable"], r["g"]): r for r in box_stats(df, ["v", "w"], "g", method="histogram").collect()}
    assert a.keys() == b.keys()
    for k in a:
        for c in ("n", "q1", "median", "q3", "whisker_lo", "whisker_hi", "n_outliers"):
            assert abs(a[k][c] - b[k][c]) < 1e-12, (k, c)


@pytest.mark.parametrize("dof", [2_501, 10_000, 1_000_000, 10 ** 9])
def test_chi_square_tail_at_many_degrees(spark, dof):
    """Against the sum rule Q(a + 1, x) = Q(a, x) + x^a e^-x / Gamma(a + 1), the median and both ends."""
    sd = math.sqrt(2 * dof)
    stats = [dof + z * sd for z in (-30, -6, -1, 0, 1, 3, 8)]
    rows = spark.createDataFrame([(float(s), d) for s in stats for d in (dof, dof + 2)], "s double, d long")
    got = {(r["s"], r["d"]): r["p"] for r in rows.select("s", "d", chi2_pvalue(F.col("s"), F.col("d")).alias("p")).collect()}
    for s in stats:
        a, x = dof / 2, s / 2
        # the step in logs by Stirling's series; only where its digits suffice
        step = math.exp(a * math.log(x / a) + (a - x) - 0.5 * math.log(2 * math.pi * a) - 1 / (12 * a))
        assert got[s, dof + 2] - got[s, dof] == pytest.approx(step, rel=1e-4, abs=1e-12)
    assert got[stats[0], dof] == pytest.approx(1, abs=1e-12)
    assert got[stats[3], dof] == pytest.approx(0.5 - 2 / (3 * math.sqrt(2 * math.pi * dof / 2)) / 2, abs=2e-3 / math.sqrt(dof) + 1e-6)
    assert 0 < got[stats[6], dof] < 1e-9 < got[stats[5], dof] < 0.01


def test_chi_square_tail_is_continuous_where_the_form_changes(spark):
    rows = spark.createDataFrame([(2500.0 + z * 70, d) for z in (-3, 0, 2, 6) for d in (2499, 2500, 2501, 2502)], "s double, d long")
    got = [r["p"] for r in rows.select(chi2_pvalue(F.col("s"), F.col("d")).alias("p")).collect()]
    for a, b, c, d in zip(got[::4], got[1::4], got[2::4], got[3::4]):
        assert b - a == pytest.approx(c - b, rel=0.1, abs=1e-12) and c - b == pytest.approx(d - c, rel=0.1, abs=1e-12)
