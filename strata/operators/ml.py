"""Feature matrix, stratified split and folds, and the evaluation of predictions.

* The split and the folds are exact per class: each class's rows are ordered by
  ``md5(id:seed)``, and the rows at the cut positions are found from counts per hash range. The
  first ``round(test_fraction * n_class)`` rows of a class are the test part; the folds are k
  consecutive parts of the order. Rows are compared with the cuts in the scan.
* The classifiers are in ``operators/trees.py`` and ``operators/logistic.py``.
* Every evaluation number is an aggregate over the prediction DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window, functions as F

from strata.operators.joins import join_small, materialize
from strata.operators.windows import bucket_target, hash_prefix_for, passed_cuts, position_cuts
from strata.sources import schema as S

LABEL = "label"


def model_frame(feat: DataFrame, feature_cols: Sequence[str] = tuple(S.FEATURE_COLS),
                label_col: str = "Diagnosis_Class", id_col: str = "id") -> DataFrame:
    """``(id, label, <features...>)`` rows with a known label and no missing feature
    (those rows cannot be fitted or scored)."""
    cols = [F.col(c).cast("double").alias(c) for c in feature_cols]
    out = feat.select(id_col, F.col(label_col).cast("double").alias(LABEL), *cols)
    # only columns the schema marks nullable can hold NULL: checking just those keeps
    # the (pushed-down) filter from re-evaluating every derived feature expression
    nullable = [f.name for f in out.schema.fields if f.nullable and f.name in {LABEL, *feature_cols}]
    return out.dropna(subset=nullable) if nullable else out


def _hash_cuts(df: DataFrame, label: str, id_col: str, seed: int, positions) -> tuple[DataFrame, DataFrame]:
    """Rows with their hash order ``__h`` (md5 of ``id:seed``) and its range ``__r``, and each
    class's cut rows in that order: ranges are counted, and only the ranges that hold a cut are
    looked into."""
    x = df.withColumn("__h", F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}"))))
    digits = hash_prefix_for(bucket_target(df.sparkSession))
    x = x.withColumn("__r", F.substring("__h", 1, digits))
    # the counts, the ranges with a cut and their rows read the narrow table, not the frame
    narrow = materialize(x.select(label, "__r", "__h"), "order")
    return x, position_cuts(narrow, [label], "__r", "__h", positions)


def _passed(df: DataFrame, label: str, id_col: str, seed: int, positions, name: str) -> DataFrame:
    x, cuts = _hash_cuts(df, label, id_col, seed, positions)
    rows = join_small(x, cuts, [label], how="left", null_safe=True)
    return (rows.withColumn(name, passed_cuts(F.col("cuts"), F.col("__r"), F.col("__h")))
            .withColumn("__some", F.size(F.coalesce("cuts", F.array())) > 0).drop("cuts", "__h", "__r"))


def stratified_split(df: DataFrame, label: str = LABEL, id_col: str = "id",
                     test_fraction: float = S.SPLIT_TEST_FRACTION, seed: int = S.SEED) -> DataFrame:
    """Adds ``part`` = 'test' for the first round(test_fraction * class size) rows of each
    class in hash order, else 'train'. Exact per-class counts. Only the cut row of each class is
    looked for; the rows are labelled where they are scanned and not shuffled."""
    n_test = lambda n: F.array(F.round(n * F.lit(test_fraction)).cast("bigint"))
    rows = _passed(df, label, id_col, seed, n_test, "__after")
    test = F.col("__some") & (F.col("__after") == 0)
    return rows.withColumn("part", F.when(test, "test").otherwise("train")).drop("__after", "__some")


def stratified_folds(df: DataFrame, k: int = S.CV_FOLDS, label: str = LABEL, id_col: str = "id",
                     seed: int = S.SEED) -> DataFrame:
    """Adds ``fold`` in 0..k-1: each class in hash order is cut into k consecutive parts whose
    sizes differ by at most one (the first ones are larger); k - 1 cut rows per class."""
    def ends(n):
        q, r = F.floor(n / k), n % k
        return F.array(*[(F.lit(j) * q + F.least(F.lit(j), r)).cast("long") for j in range(1, k)])

    return _passed(df, label, id_col, seed, ends, "fold").withColumn("fold", F.col("fold").cast("int")).drop("__some")


def split_report(split: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows per (part, class)."""
    return (split.groupBy("part", F.col(label).cast("int").alias("class"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy("part", "class"))


def _assembler(feature_cols: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(feature_cols), outputCol=out, handleInvalid="error")


# --- evaluation -----------------------------------------------------------------------

def accuracy(pred: DataFrame) -> DataFrame:
    return pred.agg(F.avg((F.col(LABEL) == F.col("prediction")).cast("double")).alias("accuracy"),
                    F.count(F.lit(1)).alias("n"))


def confusion(pred: DataFrame, classes: Sequence[int] = tuple(S.DIAGNOSIS_LABELS)) -> DataFrame:
    """Counts per (actual, predicted) as a wide table plus row percent (recall per
    class): ``(actual, pred_<c>..., pct_<c>...)``. One row per class present among the actual
    or the predicted labels; a class that is only predicted has zeros and NULL percents."""
    long = (pred.groupBy(F.col(LABEL).cast("int").alias("a"), F.col("prediction").cast("int").alias("p"))
            .agg(F.count(F.lit(1)).alias("n")))
    hits = [F.sum(F.when((F.col("a") == F.col("actual")) & (F.col("p") == c) & F.col("own"), F.col("n")).otherwise(0))
            .cast("bigint").alias(f"pred_{c}") for c in classes]
    # the (a, p) cell is exploded to both its classes; it counts in the row of its actual class once
    seen = long.select(F.posexplode(F.array("a", "p")).alias("side", "actual"), "a", "p", "n")
    wide = seen.withColumn("own", F.col("side") == 0).groupBy("actual").agg(*hits)
    total = F.nullif(sum((F.col(f"pred_{c}") for c in classes), F.lit(0)), F.lit(0))
    pcts = [(F.lit(100.0) * F.col(f"pred_{c}") / total).alias(f"pct_{c}") for c in classes]
    return wide.select("*", *pcts).orderBy("actual")


def classification_report(pred: DataFrame, names: dict | None = None) -> DataFrame:
    """Precision, recall, F1 and support of every class present among the actual or the predicted
    labels, then accuracy, macro and weighted averages (zero denominators give 0). Everything
    comes from the (actual, predicted) counts, one aggregate of the predictions."""
    names = names or S.DIAGNOSIS_LABELS
    cells = (pred.groupBy(F.col(LABEL).cast("int").alias("a"), F.col("prediction").cast("int").alias("p"))
             .agg(F.count(F.lit(1)).alias("n")))
    sides = cells.select(F.posexplode(F.array("a", "p")).alias("side", "c"), "a", "p", "n")
    per = sides.groupBy("c").agg(
        F.sum(F.when((F.col("side") == 0) & (F.col("a") == F.col("p")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("pp"),
        F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).cast("bigint").alias("support"))
    tp, pp, sup = F.col("tp"), F.col("pp"), F.col("support")
    per = (per.withColumn("precision", F.when(pp > 0, tp / pp).otherwise(F.lit(0.0)))
           .withColumn("recall", F.when(sup > 0, tp / sup).otherwise(F.lit(0.0))))
    both = F.col("precision") + F.col("recall")
    per = per.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)))
    label = F.coalesce(*[F.when(F.col("c") == c, F.lit(v)) for c, v in names.items()], F.col("c").cast("string"))
    rows = per.select(label.alias("class"), "precision", "recall", "f1", "support")
    none = F.lit(None).cast("double")
    weigh = lambda m: F.sum(F.col(m) * sup) / F.sum(sup)
    tails = per.agg(F.array(
        F.struct(F.lit("accuracy").alias("class"), none.alias("precision"), none.alias("recall"),
                 (F.sum("tp") / F.sum(sup)).alias("f1"), F.sum(sup).alias("support")),
        F.struct(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                 F.avg("f1").alias("f1"), F.sum(sup).alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), weigh("precision").alias("precision"), weigh("recall").alias("recall"),
                 weigh("f1").alias("f1"), F.sum(sup).alias("support"))).alias("t")).select(F.inline("t"))
    return rows.unionByName(tails)


def ranked_importances(imps: DataFrame, engineered: Sequence[str] = tuple(S.ENGINEERED_FEATURES), top: int = 10) -> DataFrame:
    """(feature, importance) ascending as in the chart, with the engineered-feature mark, the mean,
    the rank from the top (ties by name) and whether it is among the ``top``. One row per feature."""
    df = imps.withColumn("engineered", F.col("feature").isin(list(engineered)))
    df = df.withColumn("mean_importance", F.avg("importance").over(Window.partitionBy()))
    df = df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))
    return df.withColumn("top", F.col("rank") <= top).orderBy("importance", "feature")


def best_first(results: DataFrame) -> DataFrame:
    """(model, accuracy, n, _pos) with ``best``: the highest accuracy, the first listed on a tie."""
    order = [F.desc("accuracy"), F.asc("_pos")]
    return results.withColumn("best", F.row_number().over(Window.orderBy(*order)) == 1).orderBy(*order).drop("_pos")
