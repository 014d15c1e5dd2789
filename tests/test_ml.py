"""Split, folds and models: exactness of the split, ranges of the model outputs."""

from dataclasses import replace

from pyspark.sql import functions as F

from strata.operators import ml as ML
from strata.operators.clean import features
from strata.plans import models as MD
from strata.sources.cohort import patients_raw


def _rows(spark, sf_small):
    return ML.model_frame(features(patients_raw(spark, sf_small)))


def test_split_is_exact_disjoint_and_complete(spark, sf_small):
    rows = _rows(spark, sf_small)
    split = ML.stratified_split(rows).cache()
    assert split.count() == rows.count()
    assert split.select("id").distinct().count() == rows.count()
    per = {(r["part"], r["label"]): r["count"] for r in split.groupBy("part", "label").count().collect()}
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    for lab, n in sizes.items():
        assert per.get(("test", lab), 0) == int(n * 0.2 + 0.5)
        assert per.get(("test", lab), 0) + per.get(("train", lab), 0) == n


def test_folds_balanced(spark, sf_small):
    folds = ML.stratified_folds(_rows(spark, sf_small), k=5)
    d = folds.groupBy("label", "fold").count().groupBy("label").agg(
        (F.max("count") - F.min("count")).alias("d"), F.countDistinct("fold").alias("k"))
    assert all(r["d"] <= 1 and r["k"] == 5 for r in d.collect())


FEW = replace(MD.SHALLOW, trees=10, depth=5, bins=64)


def test_forest_outputs(spark, sf_small):
    raw = patients_raw(spark, sf_small)
    nodes, pred = MD.forest_fit(raw, FEW)
    acc = ML.accuracy(pred).collect()[0]["accuracy"]
    test = ML.stratified_split(_rows(spark, sf_small)).where("part = 'test'")
    majority = test.groupBy("label").count().agg(F.max("count")).collect()[0][0] / test.count()
    assert acc >= majority and pred.count() == test.count()
    assert nodes.select("tree").distinct().count() == 10
    imp = MD.rf_importance(raw, FEW).collect()
    assert len(imp) == 22 and abs(sum(r["importance"] for r in imp) - 1.0) < 1e-6
    rep = {r["class"]: r for r in MD.rf_report(raw, FEW).collect()}
    assert abs(rep["accuracy"]["f1"] - acc) < 1e-12
    for r in MD.rf_confusion(raw, FEW).collect():
        assert abs(sum(r[f"pct_{c}"] for c in range(4)) - 100.0) < 1e-9


def test_kept_fit_depends_on_settings_and_content(spark, sf_small):
    raw = patients_raw(spark, sf_small)
    a = MD.forest_fit(raw, FEW)[1]
    assert MD.forest_fit(raw, FEW)[1].inputFiles() == a.inputFiles()
    other = [replace(FEW, seed=7), replace(FEW, least=9)]
    files = {tuple(sorted(MD.forest_fit(raw, s)[1].inputFiles())) for s in [FEW, *other]}
    files.add(tuple(sorted(MD.forest_fit(raw.where("id % 10 > 0"), FEW)[1].inputFiles())))
    assert len(files) == 4


def test_models_are_compared_on_the_same_rows(spark, sf_small):
    got = MD.model_comparison(patients_raw(spark, sf_small), replace(FEW, rounds=3)).collect()
    assert {r["model"] for r in got} == {"Random Forest", "Gradient Boosting", "Logistic Regression"}
    assert len({r["n"] for r in got}) == 1 and [r["best"] for r in got] == [True, False, False]
    assert all(0.3 < r["accuracy"] <= 1 for r in got)


def test_split_independent_of_input_partitioning(spark, sf_small):
    rows = _rows(spark, sf_small)
    a = ML.stratified_split(rows.repartition(1)).select("id", "part")
    b = ML.stratified_split(rows.repartition(50)).select("id", "part")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_fits_use_every_core(spark, sf_small):
    """The rows of a fit lie in enough files, however few bytes they are."""
    cores = spark.sparkContext.defaultParallelism
    for rows in (*MD._split(patients_raw(spark, sf_small)), *MD._binned_split(patients_raw(spark, sf_small), FEW)):
        assert 2 * rows.rdd.getNumPartitions() >= cores
        assert len(rows.inputFiles()) >= 2 or cores == 1
