"""The fits use every row of a table larger than what they were once cut to (2,000,000 rows): compared with
forests grown here on all rows. All on the settings that SQL can state."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import logistic as LG
from strata.operators import ml as ML
from strata.operators import trees as TR
from strata.operators.joins import materialize
from strata.plans import findings as FI
from strata.plans import models as MD
from strata.sources import schema as S
from strata.sources.cohort import cohort_from_orders

N = 2_600_000  # four fifths are more than 2,000,000
PICK = MD.SHALLOW


@pytest.fixture(scope="module")
def raw(spark):
    orders = spark.range(N).select(
        F.col("id").alias("o_orderkey"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(15_000))).alias("o_custkey"),
        (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(50_000_000)) / 100).cast("double").alias("o_totalprice"),
        F.lit("1-URGENT").alias("o_orderpriority"))
    return cohort_from_orders(materialize(orders, "orders"))


@pytest.fixture(scope="module")
def split(raw):
    return materialize(ML.stratified_split(MD.stored_rows(raw, None)).repartition(16), "split")


@pytest.fixture(scope="module")
def whole(split):
    """(node table, scored test rows) of the forest on all training rows."""
    train, test = split.where("part = 'train'"), split.where("part = 'test'")
    cuts = TR.feature_cuts(train, S.FEATURE_COLS, PICK.bins)
    binned = [TR.binned(part.withColumn(ML.LABEL, F.col(ML.LABEL).cast("int")).withColumn("fold", F.lit(0)),
                        S.FEATURE_COLS, cuts, ["id", ML.LABEL, "fold"]) for part in (train, test)]
    nodes = TR.grow_forest(binned[0], PICK.forest())
    return nodes, materialize(TR.forest_scores(binned[1], nodes, PICK.forest()), "scores")


def rows_of(df):
    return sorted(map(repr, df.collect()))


def sampled_sums(ids, labels, tree):
    """Class sums of the bootstrap weights of rows in a tree: those of its root."""
    return np.bincount(labels, weights=TR.poisson_weights(ids, tree, PICK.seed), minlength=4).astype(int).tolist()


def spied(monkeypatch, module, name):
    """The row counts that a fit is called with."""
    seen, fit = [], getattr(module, name)

    def spy(rows, *args, **kw):
        seen.append(rows.count())
        return fit(rows, *args, **kw)
    monkeypatch.setattr(module, name, spy)
    return seen


@pytest.fixture(scope="module")
def folds(raw):
    """(fold sizes, the fit's calls, node table, result) of the cross-validation."""
    with pytest.MonkeyPatch.context() as patch:
        seen, cuts, tables = spied(patch, TR, "grow_forest"), spied(patch, TR, "feature_cuts"), []
        spy = TR.grow_forest
        patch.setattr(TR, "grow_forest", lambda *a, **kw: tables.append(spy(*a, **kw)) or tables[-1])
        got = MD.cv_accuracy_shallow(raw).collect()
    return seen, cuts, tables[0], got


def test_cv_accuracy_grows_on_all_rows_of_the_other_folds(folds, raw):
    seen, _, nodes, got = folds
    assert seen == [N] and sum(r["n"] for r in got) == N
    rows = ML.stratified_folds(MD.stored_rows(raw)).select("id", F.col(ML.LABEL).cast("int").alias("y"), "fold").toArrow()
    ids, labels, fold = (rows[c].to_numpy() for c in ("id", "y", "fold"))
    roots = {r["tree"]: list(r["counts"]) for r in nodes.where("node = 1").collect()}
    for tree in (0, 4, 14):
        others = fold != tree // PICK.trees
        assert roots[tree] == sampled_sums(ids[others], labels[others], tree % PICK.trees)


def test_cv_accuracy_shallow_cuts_come_from_all_rows(folds):
    assert folds[1] == [N]


def test_forest_nodes_count_all_training_rows(raw, split, whole):
    got = MD.forest_nodes(raw)
    assert rows_of(got) == rows_of(whole[0].select(
        "tree", "node", "feature", "bin", *[F.col("counts")[c].alias(f"class_{c}") for c in S.DIAGNOSIS_LABELS]))
    train = split.where("part = 'train'").select("id", F.col(ML.LABEL).cast("int").alias("y")).toArrow()
    for r in got.where("node = 1").collect():
        assert [r[f"class_{c}"] for c in range(4)] == sampled_sums(train["id"].to_numpy(), train["y"].to_numpy(), r["tree"])


def test_forest_predictions_are_votes_of_the_whole_forest(raw, whole):
    got, want = MD.forest_predictions(raw), whole[1].select("id", ML.LABEL, F.col("prediction").cast("int").alias("prediction"))
    assert got.count() == want.count() > 500_000
    assert got.exceptAll(want).isEmpty()


def importances(nodes):
    imps = TR.impurity_importances(nodes, S.FEATURE_COLS)
    return rows_of(ML.ranked_importances(imps.withColumn("importance", F.round("importance", 9))))


def test_forest_importance_is_that_of_the_whole_forest(raw, whole):
    assert rows_of(MD.forest_importance(raw)) == importances(whole[0])


def test_rf_importance_is_that_of_the_whole_forest(raw, whole):
    assert rows_of(MD.rf_importance(raw, PICK)) == importances(whole[0])


def test_rf_confusion_is_that_of_the_whole_forest(raw, whole):
    assert rows_of(MD.rf_confusion(raw, PICK)) == rows_of(ML.confusion(whole[1]))


def test_rf_report_is_that_of_the_whole_forest(raw, whole):
    assert rows_of(MD.rf_report(raw, PICK)) == rows_of(ML.classification_report(whole[1]))


@pytest.fixture(scope="module")
def compared(raw):
    """(rows that boosting and the regression are fitted on, the node tables ranked, the key findings)."""
    with pytest.MonkeyPatch.context() as patch:
        boosted, regressed, ranked = spied(patch, TR, "grow_boosting"), spied(patch, LG, "fit_logistic"), []
        rank = TR.impurity_importances
        patch.setattr(TR, "impurity_importances", lambda nodes, *a: ranked.append(nodes) or rank(nodes, *a))
        got = FI.key_findings(raw, PICK).collect()[0]
    return boosted, regressed, ranked, got


def test_model_comparison_fits_every_model_on_all_training_rows(compared, split):
    n = split.where("part = 'train'").count()
    assert n > 2_000_000 and compared[0] == [n] and set(compared[1]) == {n}


def test_key_findings_rank_the_whole_forest(compared, whole):
    assert compared[3]["patients"] == N and len(compared[2]) == 1
    assert rows_of(compared[2][0]) == rows_of(whole[0])
    top = TR.impurity_importances(whole[0], S.FEATURE_COLS).orderBy(F.desc(F.round("importance", 9)), "feature").first()
    assert compared[3]["top_feature"] == top["feature"]
