"""Model queries of the notebook: split, folds, forest report, confusion matrix,
importances, cross-validated accuracy, model comparison and the key findings.

The split rows are written once as Parquet in the shared checkpoint folder before fitting (the
fit and the scoring both read them, and a lost executor re-reads the files instead of recomputing
the split). One forest fit serves all reports on the same content.

The ``rule_*`` queries run the same evaluation code on the predictions of a plain rule, which SQL
can state too: they check accuracy, report, confusion, folds and choice of the best exactly.
"""

from __future__ import annotations

import hashlib
import inspect
import math
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from strata.operators import logistic as LG
from strata.operators import ml as ML
from strata.operators import moments as MO
from strata.operators import trees as TR
from strata.operators.clean import features
from strata.operators.joins import materialize
from strata.session import ensure_checkpoint_dir
from strata.sources import schema as S
from strata.sources.sinks import shared_scratch


def model_rows(raw: DataFrame) -> DataFrame:
    return ML.model_frame(features(raw))


def stored_rows(raw: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """The model frame (or its key, label and ``columns``), written once: the features are derived in one
    scan, and every step after reads plain columns."""
    rows = model_rows(raw)
    return materialize(rows.select("id", ML.LABEL, *columns) if columns is not None else rows, "frame")


RULE_COLUMNS = ("Hyperactivity_Index", "Inattention_Index", "Total_Severity")


def split_assignment(raw: DataFrame) -> DataFrame:
    split = ML.stratified_split(stored_rows(raw))
    return split.select("id", F.col(ML.LABEL).cast("int").alias("class"), "part")


def split_report(raw: DataFrame) -> DataFrame:
    return ML.split_report(ML.stratified_split(stored_rows(raw)))


def fold_assignment(raw: DataFrame) -> DataFrame:
    folds = ML.stratified_folds(stored_rows(raw))
    return folds.select("id", F.col(ML.LABEL).cast("int").alias("class"), "fold")


def fold_sizes(raw: DataFrame) -> DataFrame:
    folds = ML.stratified_folds(stored_rows(raw))
    return (folds.groupBy("fold", F.col(ML.LABEL).cast("int").alias("class"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy("fold", "class"))


PART_ROWS = 500_000  # rows of the frame that one task fits or scores at most


def _spread(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` ``rows`` written in at least two files per core: the work on a row is trees and passes, not
    bytes, so the few files that its bytes make would leave most cores idle."""
    parts = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-n // PART_ROWS))
    return materialize(rows.repartition(parts))


def _split(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(training rows, test rows), all of them."""
    frame = stored_rows(raw, None)
    data = _spread(ML.stratified_split(frame), frame.count())
    return data.where(F.col("part") == "train"), data.where(F.col("part") == "test")


def _fingerprint(df: DataFrame) -> str:
    """A digest of the table's content, whatever its order: row count and two sums of row hashes."""
    h = df.select(F.xxhash64(*df.columns).alias("a"), F.hash(*df.columns).cast("long").alias("b"))
    r = h.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum("b")).first()
    return repr(tuple(r))


def _code_version() -> str:
    """A digest of the code that fits, so that kept results do not outlive a change of it."""
    return "".join(inspect.getsource(m) for m in (TR, ML, sys.modules[__name__]))


@dataclass(frozen=True)
class TreeSettings:
    """How trees are fitted; the defaults are those of the analysed workload."""
    trees: int = S.RF_TREES
    depth: int = S.RF_DEPTH
    least: int = S.RF_MIN_LEAF
    chosen: int = math.isqrt(len(S.FEATURE_COLS))
    bins: int = S.MAX_BINS
    seed: int = S.SEED
    rounds: int = S.GBT_ROUNDS
    boost_depth: int = S.GBT_DEPTH
    step: float = S.GBT_STEP

    def forest(self, folds: int = 0) -> TR.ForestSettings:
        return TR.ForestSettings(len(S.FEATURE_COLS), len(S.DIAGNOSIS_LABELS), self.trees, self.depth, self.least,
                                 self.chosen, self.seed, folds)

    def boosting(self) -> TR.BoostSettings:
        return TR.BoostSettings(len(S.FEATURE_COLS), len(S.DIAGNOSIS_LABELS), self.rounds, self.boost_depth, self.step)


BOOST_NODES = "tree int, node int, feature int, bin int, residual long, curvature long, rows long, value double"
# small enough for a SQL statement to grow the same trees
SHALLOW = TreeSettings(trees=3, depth=2, bins=16, rounds=2, boost_depth=2)


def _binned(fitted_on: DataFrame, rows: DataFrame, settings: TreeSettings, fold: str | None = None) -> DataFrame:
    """(id, label, fold, bins) of ``rows``; the cuts come from the rows that are fitted on."""
    cuts = TR.feature_cuts(fitted_on, S.FEATURE_COLS, settings.bins)
    typed = rows.withColumn(ML.LABEL, F.col(ML.LABEL).cast("int"))
    typed = typed.withColumn("fold", F.col(fold).cast("int") if fold else F.lit(-1))
    return materialize(TR.binned(typed, S.FEATURE_COLS, cuts, ["id", ML.LABEL, "fold"]), "binned")


def _moved(spark, source: str, target: str) -> None:
    """Renames a finished folder; one that another session finished first stays."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(target)):
        fs.rename(path(source), path(target))


def _kept(raw: DataFrame, name: str, settings: TreeSettings, build: Callable[[str], None]) -> str:
    """The folder of a fit's tables, which ``build`` writes if they are not there yet.

    One fit serves every report: the tables are kept in the shared checkpoint folder under a digest
    of the model frame, all settings and the fitting code. They are written to a fresh folder and
    renamed when complete, so two sessions never write one path."""
    spark = raw.sparkSession
    key = repr((name, _fingerprint(model_rows(raw)), settings, S.FEATURE_COLS, S.SPLIT_TEST_FRACTION, TR.SMALL_NODE, _code_version()))
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/strata-{name}-{hashlib.sha256(key.encode()).hexdigest()[:32]}"
    done = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        fresh = shared_scratch(spark, f"{name}-fit")
        build(fresh)
        _moved(spark, fresh, path)
    return path


def _binned_split(raw: DataFrame, settings: TreeSettings) -> tuple[DataFrame, DataFrame]:
    """Binned training rows and test rows of the split."""
    train, test = _split(raw)
    both = _binned(train, train.withColumn("_p", F.lit(0)).unionByName(test.withColumn("_p", F.lit(1))), settings, "_p")
    return both.where("fold = 0"), both.where("fold = 1")


def forest_fit(raw: DataFrame, settings: TreeSettings = TreeSettings()) -> tuple[DataFrame, DataFrame]:
    """(node table, scored test rows) of the forest on the split."""
    def build(fresh: str) -> None:
        train, test = _binned_split(raw, settings)
        forest = settings.forest()
        nodes = TR.grow_forest(train, forest)
        nodes.write.parquet(f"{fresh}/nodes")
        TR.forest_scores(test, nodes, forest).write.parquet(f"{fresh}/scored")

    path = _kept(raw, "forest", settings, build)
    return raw.sparkSession.read.parquet(f"{path}/nodes"), raw.sparkSession.read.parquet(f"{path}/scored")


def rf_report(raw: DataFrame, settings: TreeSettings = TreeSettings()) -> DataFrame:
    return ML.classification_report(forest_fit(raw, settings)[1])


def rf_confusion(raw: DataFrame, settings: TreeSettings = TreeSettings()) -> DataFrame:
    return ML.confusion(forest_fit(raw, settings)[1])


def rf_importance(raw: DataFrame, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """The importances of the forest, from its node table."""
    imps = TR.impurity_importances(forest_fit(raw, settings)[0], S.FEATURE_COLS)
    return ML.ranked_importances(imps.withColumn("importance", F.round("importance", 9)))


def cv_accuracy(raw: DataFrame, k: int = S.CV_FOLDS, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """Stratified k-fold accuracy of the forest: one row per fold plus the mean and the population sd
    over folds. All k forests grow in the same passes; a tree gives its own fold's rows no weight."""
    frame = stored_rows(raw, None)
    folds = _spread(ML.stratified_folds(frame, k), frame.count())
    rows, forest = _binned(folds, folds, settings, "fold"), settings.forest(k)
    scored = TR.forest_scores(rows, TR.grow_forest(rows, forest), forest, keep=("id", ML.LABEL, "fold"))
    per = scored.groupBy("fold").agg(F.avg((F.col(ML.LABEL) == F.col("prediction")).cast("double")).alias("accuracy"),
                                     F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    return (per.withColumn("mean_accuracy", F.avg("accuracy").over(w)).withColumn("std_accuracy", F.stddev_pop("accuracy").over(w))
            .select("fold", "n", "accuracy", "mean_accuracy", "std_accuracy").orderBy("fold"))


def boosting_fit(raw: DataFrame, settings: TreeSettings = TreeSettings()) -> tuple[DataFrame, DataFrame]:
    """(node table, scored test rows) of multinomial boosting on the split."""
    spark = raw.sparkSession

    def build(fresh: str) -> None:
        train, test = _binned_split(raw, settings)
        nodes, prior = TR.grow_boosting(train, settings.boosting())
        rows = [(t, n, f, b, *map(int, sums), v) for t, n, f, b, sums, v in nodes]
        spark.createDataFrame(rows, BOOST_NODES).write.parquet(f"{fresh}/nodes")
        TR.boosting_scores(test, nodes, prior, settings.boosting()).write.parquet(f"{fresh}/scored")

    path = _kept(raw, "boosting", settings, build)
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/scored")


def logistic_fit(raw: DataFrame):
    """(model, scored test rows) of the logistic regression on the split."""
    train, test = _split(raw)
    model = LG.fit_logistic(train, S.FEATURE_COLS, len(S.DIAGNOSIS_LABELS), ML.LABEL)
    return model, LG.logistic_scores(test, model)


def model_comparison(raw: DataFrame, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """Test accuracy of the forest, boosting and logistic regression (standardised features) on the
    same split, best first."""
    results = None
    fits = [("Random Forest", lambda: forest_fit(raw, settings)[1]), ("Gradient Boosting", lambda: boosting_fit(raw, settings)[1]),
            ("Logistic Regression", lambda: logistic_fit(raw)[1])]
    for pos, (name, scored) in enumerate(fits):
        acc = materialize(ML.accuracy(scored()).select(F.lit(name).alias("model"), "accuracy", "n", F.lit(pos).alias("_pos")))
        results = acc if results is None else results.unionByName(acc)
    return ML.best_first(results)


# --- the same fits at a size that SQL can state ------------------------------------------

def forest_nodes(raw: DataFrame) -> DataFrame:
    """The node table of a small forest on the training rows."""
    nodes = forest_fit(raw, SHALLOW)[0]
    return nodes.select("tree", "node", "feature", "bin", *[F.col("counts")[c].alias(f"class_{c}") for c in S.DIAGNOSIS_LABELS])


def forest_predictions(raw: DataFrame) -> DataFrame:
    """The small forest's votes on the test rows."""
    return forest_fit(raw, SHALLOW)[1].select("id", ML.LABEL, F.col("prediction").cast("int").alias("prediction"))


def forest_importance(raw: DataFrame) -> DataFrame:
    return rf_importance(raw, SHALLOW)


def cv_accuracy_shallow(raw: DataFrame) -> DataFrame:
    return cv_accuracy(raw, settings=SHALLOW)


def boosting_nodes(raw: DataFrame) -> DataFrame:
    """The trees of two rounds of boosting: cuts, and in the leaves what they add."""
    return boosting_fit(raw, SHALLOW)[0].withColumn("value", F.round("value", 9))


def boosting_predictions(raw: DataFrame) -> DataFrame:
    return boosting_fit(raw, SHALLOW)[1].select("id", ML.LABEL, F.col("prediction").cast("int").alias("prediction"))


def logistic_gradient(raw: DataFrame) -> DataFrame:
    """Per class and coefficient whether the penalised gradient at the fitted coefficients, summed anew
    by SQL expressions over the training rows, is below 1e-6 per row of the penalty's scale."""
    train, _ = _split(raw)
    model = LG.fit_logistic(train, S.FEATURE_COLS, len(S.DIAGNOSIS_LABELS), ML.LABEL)
    k = len(S.FEATURE_COLS)
    x = [(F.col(c) - float(model.mean[i])) / float(model.sd[i]) for i, c in enumerate(S.FEATURE_COLS)] + [F.lit(1.0)]
    z = train.select(ML.LABEL, F.array(*x).alias("x"))
    dots = [F.aggregate(F.zip_with("x", F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
            for w in model.weights]
    z = z.select(ML.LABEL, "x", F.array(*dots).alias("z")).withColumn("e", F.transform("z", lambda v: F.exp(v - F.array_max("z"))))
    z = z.withColumn("s", F.aggregate("e", F.lit(0.0), lambda a, b: a + b))
    long = z.select(ML.LABEL, "x", "s", F.posexplode("e").alias("class", "ek"))
    off = F.col("ek") / F.col("s") - (F.col(ML.LABEL) == F.col("class")).cast("double")
    sums = (long.select("class", off.alias("off"), F.posexplode("x").alias("place", "xi"))
            .groupBy("class", "place").agg(F.sum(F.col("off") * F.col("xi")).alias("g")))
    weights = raw.sparkSession.createDataFrame(
        [(a, i, float(model.weights[a, i]) if i < k else 0.0) for a in range(len(model.weights)) for i in range(k + 1)],
        "class int, place int, w double")
    names = F.element_at(F.array(*[F.lit(c) for c in [*S.FEATURE_COLS, "intercept"]]), F.col("place") + 1)
    return (sums.join(F.broadcast(weights), ["class", "place"])
            .select("class", names.alias("feature"), (F.abs(F.col("g") + F.col("w")) < 1e-6).alias("at_optimum")))


def logistic_two_classes(raw: DataFrame) -> DataFrame:
    """Coefficients of the class-0-or-not regression on two features, as SQL's own Newton steps find them."""
    train, _ = _split(raw)
    rows = train.withColumn("y", (F.col(ML.LABEL) != 0).cast("int"))
    model = LG.fit_logistic(rows, ["Total_Severity", "Sleep_Hours"], 2, "y", tolerance=1e-9)
    # the two classes' coefficients are opposite; the log odds are their difference
    odds = model.weights[1] - model.weights[0]
    return (raw.sparkSession.createDataFrame([(n, float(v)) for n, v in zip([*model.features, "intercept"], odds)], "name string, odds double")
            .withColumn("odds", F.round("odds", 6)))


# --- the evaluation on a rule's predictions -------------------------------------------

def _rules() -> dict:
    h, i, t = F.col("Hyperactivity_Index"), F.col("Inattention_Index"), F.col("Total_Severity")
    return {"Balance rule": F.when(h - i > 3, 2.0).when(i - h > 3, 1.0).when(t >= 30, 3.0).otherwise(0.0),
            "Severity rule": F.when(t >= 36, 3.0).when(t >= 27, 2.0).when(t >= 20, 1.0).otherwise(0.0),
            "Never class 3": F.when(t >= 27, 2.0).otherwise(0.0)}


def _ruled(rows: DataFrame, name: str = "Balance rule") -> DataFrame:
    return rows.withColumn("prediction", _rules()[name])


def rule_report(raw: DataFrame) -> DataFrame:
    return ML.classification_report(_ruled(model_rows(raw)))


def rule_report_few_classes(raw: DataFrame) -> DataFrame:
    """Two classes among the labels and three among the predictions."""
    return ML.classification_report(_ruled(model_rows(raw).where(F.col(ML.LABEL).isin(0.0, 1.0)), "Never class 3"))


def rule_confusion(raw: DataFrame) -> DataFrame:
    return ML.confusion(_ruled(model_rows(raw)))


def rule_cv_accuracy(raw: DataFrame) -> DataFrame:
    folds = _ruled(ML.stratified_folds(stored_rows(raw, RULE_COLUMNS)))
    per = folds.groupBy("fold").agg(F.avg((F.col(ML.LABEL) == F.col("prediction")).cast("double")).alias("accuracy"),
                                    F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    return (per.withColumn("mean_accuracy", F.avg("accuracy").over(w)).withColumn("std_accuracy", F.stddev_pop("accuracy").over(w))
            .select("fold", "n", "accuracy", "mean_accuracy", "std_accuracy").orderBy("fold"))


def rule_comparison(raw: DataFrame) -> DataFrame:
    """Accuracy of the rules on the test rows, the best marked."""
    test = ML.stratified_split(stored_rows(raw, RULE_COLUMNS)).where(F.col("part") == "test")
    # all rules in one scan: a row per rule and its prediction
    tried = F.array(*[F.struct(F.lit(name).alias("model"), F.lit(pos).alias("_pos"), rule.alias("prediction"))
                      for pos, (name, rule) in enumerate(_rules().items())])
    hits = test.select(ML.LABEL, F.inline(tried)).withColumn("hit", (F.col(ML.LABEL) == F.col("prediction")).cast("double"))
    return ML.best_first(hits.groupBy("model", "_pos").agg(F.avg("hit").alias("accuracy"), F.count(F.lit(1)).alias("n"))
                         .select("model", "accuracy", "n", "_pos"))


def scaler_statistics(raw: DataFrame) -> DataFrame:
    """Means and population sds that the standardisation learns from the training rows."""
    train = ML.stratified_split(stored_rows(raw, None)).where(F.col("part") == "train")
    moments = MO.column_moments(train, S.FEATURE_COLS)
    pairs = [] if moments is None else zip(S.FEATURE_COLS, *map(lambda a: a.tolist(), MO.scaler(moments)))
    return raw.sparkSession.createDataFrame(list(pairs), "feature string, mean double, sd double")


def feature_vectors(raw: DataFrame) -> DataFrame:
    """The assembled 22-feature vectors, component by component."""
    out = ML._assembler(S.FEATURE_COLS).transform(model_rows(raw)).withColumn("v", vector_to_array("features"))
    return out.select("id", ML.LABEL, *[F.col("v")[i].alias(f"f{i}_{c}") for i, c in enumerate(S.FEATURE_COLS)])


def feature_correlation_rank(raw: DataFrame) -> DataFrame:
    """The importance table over |correlation with the label|."""
    moments = MO.column_moments(model_rows(raw), [*S.FEATURE_COLS, ML.LABEL])
    with_label = [] if moments is None else MO.correlation(moments)[-1, :-1].tolist()
    rows = [(c, 0.0 if math.isnan(v) else abs(v)) for c, v in zip(S.FEATURE_COLS, with_label)]
    pairs = raw.sparkSession.createDataFrame(rows, "feature string, importance double")
    return ML.ranked_importances(pairs.withColumn("importance", F.round("importance", 9)))


def split_losses(raw: DataFrame) -> DataFrame:
    """Rows of the cohort, rows that can be fitted or scored, and rows dropped for a missing value."""
    rows = features(raw).agg(F.count(F.lit(1)).alias("rows"))
    used = model_rows(raw).agg(F.count(F.lit(1)).alias("u")).scalar()
    return rows.withColumn("used", used).withColumn("dropped", F.col("rows") - F.col("used"))
