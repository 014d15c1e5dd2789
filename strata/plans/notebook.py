"""Queries of the notebook half: exploration, engineered features, chart datasets and
tests, on the raw cohort (``df_raw``) or the feature table (``df``).

NULL rules are the notebook's where the two halves differ (SURVEY §1.4-1.5): items are
summed skipping missing answers, ages outside the bands fall through to 'Adult' /
'Other', unmapped codes are NULL, grouped results drop NULL keys, and a missing
diagnosis counts as diagnosed in the prevalence-by-age rule (``NaN != 0``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strata.functions import labels as L
from strata.operators import charts as C
from strata.operators import metrics as M
from strata.operators import stats as ST
from strata.operators.clean import features
from strata.sources import schema as S


# Diagnosis_Label is a CASE over the fixed code list: at most that many labels plus NULL
DX_LABELS_BOUND = len(S.DX_ORDER) + 1


def with_labels(raw: DataFrame) -> DataFrame:
    """``df_raw`` of the notebook: the file columns plus the two label columns."""
    return raw.select(*S.CSV_SCHEMA.fieldNames(), L.diagnosis_label().alias("Diagnosis_Label"),
                      L.gender_label().alias("Gender_Label"))


def _diagnosed(null_counts: bool = True):
    c = F.col("Diagnosis_Class")
    return (c.isNull() | (c != 0)) if null_counts else (c != 0)


def dataset_profile(raw: DataFrame) -> DataFrame:
    return M.profile(with_labels(raw))


def feature_rows(raw: DataFrame) -> DataFrame:
    return features(raw)


def risk_category_counts(feat: DataFrame) -> DataFrame:
    return (feat.groupBy("Risk_Category").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "Risk_Category"))


def severity_class_counts(feat: DataFrame) -> DataFrame:
    return (feat.groupBy("Severity_Class").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), "Severity_Class"))


def diagnosis_value_counts(raw: DataFrame) -> DataFrame:
    return M.value_counts(with_labels(raw), "Diagnosis_Label", normalize_over="all", digits=1)


def gender_value_counts(raw: DataFrame) -> DataFrame:
    return M.value_counts(with_labels(raw), "Gender_Label", normalize_over="all", digits=1)


def family_history_value_counts(raw: DataFrame) -> DataFrame:
    return M.value_counts(raw, "Family_History", normalize_over="all", digits=1)


def life_stage_value_counts(raw: DataFrame) -> DataFrame:
    return M.value_counts(features(raw, with_quantile_risk=False), "Life_Stage", normalize_over="all", digits=1)


def dominant_subtype(raw: DataFrame) -> DataFrame:
    """Most common diagnosis among the diagnosed, with its share of all labelled rows."""
    df = with_labels(raw)
    top = M.mode_value(df, "Diagnosis_Label", where=_diagnosed())
    total = df.where(F.col("Diagnosis_Label").isNotNull()).agg(F.count(F.lit(1)).alias("t")).select("t").scalar()
    return top.select(F.col("value").alias("dominant_type"), F.col("count").alias("dominant_count"),
                      (F.lit(100.0) * F.col("count") / total).alias("dominant_pct"))


def rate_by_age(raw: DataFrame) -> DataFrame:
    """Per age (all ages): rows, diagnosed rows and prevalence in percent (unrounded)."""
    d = F.when(_diagnosed(), F.lit(1)).otherwise(F.lit(0))
    return (raw.where(F.col("Age").isNotNull()).groupBy("Age")
            .agg(F.count(F.lit(1)).alias("total"), F.sum(d).cast("bigint").alias("adhd_count"),
                 (F.avg(d) * F.lit(100.0)).alias("prevalence"))
            .orderBy("Age"))


def peak_age(raw: DataFrame) -> DataFrame:
    """Age with the highest prevalence (first, i.e. youngest, on ties)."""
    best = rate_by_age(raw).agg(F.min(F.struct((-F.col("prevalence")).alias("neg"), F.col("Age"))).alias("m"))
    return best.select(F.col("m.Age").alias("peak_age"), (-F.col("m.neg")).alias("peak_prevalence"))


def gender_diagnosis_counts(raw: DataFrame) -> DataFrame:
    return M.crosstab(with_labels(raw), "Gender_Label", "Diagnosis_Label", S.DX_ORDER).orderBy("Gender_Label")


def family_history_row_pct(raw: DataFrame) -> DataFrame:
    return (M.crosstab_row_pct(with_labels(raw), "Family_History", "Diagnosis_Label", S.DX_ORDER, digits=None)
            .orderBy("Family_History"))


def severity_diagnosis_counts(feat: DataFrame) -> DataFrame:
    """Severity class x diagnosis counts, rows in severity order (missing classes kept
    as zero rows), columns in diagnosis order."""
    return M.crosstab_ordered(feat, "Severity_Class", S.SEV_ORDER, "Diagnosis_Label", S.DX_ORDER)


def group_stats_table(feat: DataFrame) -> DataFrame:
    return M.group_stats(feat, ["Diagnosis_Label"], S.STAT_COLS, ("mean", "std", "median"), digits=2,
                         median_method="exact")


def describe_indices(feat: DataFrame) -> DataFrame:
    return M.describe(feat, ["Hyperactivity_Index", "Inattention_Index", "Total_Severity"], digits=2)


def correlations(raw: DataFrame) -> DataFrame:
    return M.corr_long(raw, S.CORR_COLS, digits=6)


def correlations_lower(raw: DataFrame) -> DataFrame:
    return M.corr_long(raw, S.CORR_COLS, digits=2, lower_only=True)


def correlations_with_diagnosis(raw: DataFrame) -> DataFrame:
    return M.corr_with_target(raw, S.CORR_COLS, "Diagnosis_Class", digits=6)


def age_histogram(raw: DataFrame) -> DataFrame:
    return C.histogram(raw, "Age", 30)


def risk_score_histograms(feat: DataFrame) -> DataFrame:
    return C.histogram_by_group(feat, "Risk_Score", "Diagnosis_Label", 30, groups_bound=DX_LABELS_BOUND)


def diagnosis_bars(raw: DataFrame) -> DataFrame:
    return C.ordered_counts(with_labels(raw), "Diagnosis_Label", S.DX_ORDER, share_of="all", digits=1)


def lifestyle_boxes(feat: DataFrame) -> DataFrame:
    return C.box_stats(feat, S.LIFESTYLE_VARS + ["HI_Dominance_Ratio"], "Diagnosis_Label",
                       groups_bound=DX_LABELS_BOUND)


def screen_outlier_points(feat: DataFrame) -> DataFrame:
    """The points a box plot of cubed screen time per diagnosis draws beyond whiskers of half the box."""
    x = feat.withColumn("x", F.col("Daily_Phone_Usage_Hours") * F.col("Daily_Phone_Usage_Hours") * F.col("Daily_Phone_Usage_Hours"))
    return C.box_outliers(x, "x", "Diagnosis_Label", "id", whisker=0.5)


def severity_violin_quartiles(feat: DataFrame) -> DataFrame:
    """The quartile lines inside the violins of the severity density."""
    q = C.box_stats(feat, ["Total_Severity"], "Diagnosis_Label", groups_bound=DX_LABELS_BOUND)
    return q.select("Diagnosis_Label", "n", "q1", "median", "q3")


def error_bars(feat: DataFrame) -> DataFrame:
    return C.mean_sd(feat, S.MEAN_SD_METRICS, "Diagnosis_Label", S.DX_ORDER)


def anova_severity(feat: DataFrame) -> DataFrame:
    return ST.anova_oneway(feat, "Total_Severity", "Diagnosis_Label")


def anova_severity_test(feat: DataFrame) -> DataFrame:
    return ST.with_f_pvalue(anova_severity(feat), S.SIGNIFICANCE, digits=9)


def anova_group_lines(feat: DataFrame) -> DataFrame:
    """Mean, sd and n of severity per diagnosis, in diagnosis order."""
    return (feat.where(F.col("Diagnosis_Label").isNotNull()).groupBy("Diagnosis_Label")
            .agg(F.round(F.avg("Total_Severity"), 2).alias("mean"),
                 F.round(F.stddev_samp("Total_Severity"), 2).alias("sd"),
                 F.count(F.lit(1)).alias("n"))
            .orderBy(L.order_key("Diagnosis_Label", S.DX_ORDER)))


def kruskal_lifestyle(feat: DataFrame) -> DataFrame:
    return ST.kruskal_wallis(feat, S.KRUSKAL_VARS, "Diagnosis_Label").orderBy(
        L.order_key("variable", S.KRUSKAL_VARS))


def kruskal_lifestyle_test(feat: DataFrame) -> DataFrame:
    res = kruskal_lifestyle(feat).withColumn("dof", F.col("k") - 1)
    return ST.with_chi2_pvalue(res, "h_stat", "dof", S.SIGNIFICANCE, digits=9).withColumn(
        "h_stat_2dp", F.round("h_stat", 2))


def chi_square_family(feat: DataFrame) -> DataFrame:
    return ST.chi_square(feat, "Family_History", "Diagnosis_Label")


def chi_square_family_test(feat: DataFrame) -> DataFrame:
    return ST.with_chi2_pvalue(chi_square_family(feat), "chi2", "dof", S.SIGNIFICANCE, digits=9)


def contingency_family(feat: DataFrame) -> DataFrame:
    cells = ST.contingency_cells(feat, "Family_History", "Diagnosis_Label")
    return (cells.select("Family_History", "Diagnosis_Label", F.col("observed").cast("bigint").alias("observed"),
                         F.round("expected", 6).alias("expected"))
            .orderBy("Family_History", L.order_key("Diagnosis_Label", S.DX_ORDER)))



def severity_density(feat: DataFrame) -> DataFrame:
    return C.density_grid(feat, "Total_Severity", "Diagnosis_Label", groups_bound=DX_LABELS_BOUND)


def distinct_classes(raw: DataFrame) -> DataFrame:
    return M.distinct_sorted(raw, "Diagnosis_Class")
