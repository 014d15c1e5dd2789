"""Registry of runnable queries: name -> callable(spark, sf_dir) -> DataFrame.

All entries read the driver's tables under ``sf_dir`` (or data Spark derives from
them), so their work grows with the tables. The stand-in cohort is derived from
``orders``; generic operators also run directly on ``lineitem`` and ``events``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.operators.clean import clean, features
from strata.plans import notebook as NB
from strata.plans import queries as Q
from strata.sources.cohort import patients_raw

Query = Callable[[SparkSession, str], DataFrame]


def _raw(spark: SparkSession, sf_dir: str, edge: bool = False) -> DataFrame:
    return patients_raw(spark, sf_dir, edge=edge)


def _clean(spark: SparkSession, sf_dir: str, edge: bool = False) -> DataFrame:
    return clean(_raw(spark, sf_dir, edge))


def _features(spark: SparkSession, sf_dir: str, edge: bool = False) -> DataFrame:
    return features(_raw(spark, sf_dir, edge))


def _on_clean(fn, edge: bool = False) -> Query:
    return lambda spark, sf_dir: fn(_clean(spark, sf_dir, edge))


REGISTRY: dict[str, Query] = {
    "cohort_overview": _on_clean(Q.cohort_overview),
    "life_stage_overview": _on_clean(Q.life_stage_overview),
    "diagnosis_distribution": _on_clean(Q.diagnosis_distribution),
    "diagnosis_distribution_pediatric": _on_clean(lambda c: Q.diagnosis_distribution(c, pediatric_only=True)),
    "prevalence_by_age_rolling": lambda spark, d: Q.prevalence_by_age_rolling(_raw(spark, d)),
    "life_stage_comparison": _on_clean(Q.life_stage_comparison),
    "risk_stratification": _on_clean(Q.risk_stratification),
    "percentile_table": _on_clean(Q.percentile_table),
    "sleep_buckets": _on_clean(Q.sleep_buckets),
    "screen_buckets": _on_clean(Q.screen_buckets),
    "family_history_impact": _on_clean(Q.family_history_impact),
    "executive_summary": _on_clean(Q.executive_summary),
    "comorbidity_matrix": _on_clean(Q.comorbidity_matrix),
    "gender_prevalence": _on_clean(Q.gender_prevalence),
    "gender_gap": _on_clean(Q.gender_gap),
    "education_rank": _on_clean(Q.education_rank),
    "severity_quartile": _on_clean(Q.severity_quartile),
    "severity_rank_outliers": _on_clean(Q.severity_rank_outliers),
    "clean_rows": _on_clean(lambda c: c),
}

# The same queries on the edge variant of the cohort (NULL and gap rules).
_EDGE = {
    "clean_rows": lambda c: c,
    "cohort_overview": Q.cohort_overview,
    "life_stage_overview": Q.life_stage_overview,
    "diagnosis_distribution": Q.diagnosis_distribution,
    "executive_summary": Q.executive_summary,
    "severity_quartile": Q.severity_quartile,
    "severity_rank_outliers": Q.severity_rank_outliers,
    "sleep_buckets": Q.sleep_buckets,
}
REGISTRY.update({f"{k}_edge": _on_clean(fn, edge=True) for k, fn in _EDGE.items()})
REGISTRY["prevalence_by_age_rolling_edge"] = (
    lambda spark, d: Q.prevalence_by_age_rolling(_raw(spark, d, edge=True)))


def _on_raw(fn, edge: bool = False) -> Query:
    return lambda spark, sf_dir: fn(_raw(spark, sf_dir, edge))


def _on_features(fn, edge: bool = False) -> Query:
    return lambda spark, sf_dir: fn(_features(spark, sf_dir, edge))


_NB_RAW = ["dataset_profile", "feature_rows", "diagnosis_value_counts", "dominant_subtype",
           "rate_by_age", "peak_age", "gender_diagnosis_counts", "family_history_row_pct",
           "correlations", "correlations_lower", "correlations_with_diagnosis", "age_histogram",
           "diagnosis_bars"]
_NB_FEATURES = ["risk_category_counts", "severity_class_counts", "severity_diagnosis_counts",
                "group_stats_table", "describe_indices", "risk_score_histograms", "lifestyle_boxes",
                "error_bars", "anova_severity", "anova_group_lines", "kruskal_lifestyle",
                "chi_square_family", "contingency_family",
                # with p-values: checked by rows only
                "anova_severity_test", "kruskal_lifestyle_test", "chi_square_family_test"]
REGISTRY.update({k: _on_raw(getattr(NB, k)) for k in _NB_RAW})
REGISTRY.update({k: _on_features(getattr(NB, k)) for k in _NB_FEATURES})
# the notebook queries on the edge variant (NULL and gap rules of the notebook half)
REGISTRY.update({f"{k}_edge": _on_raw(getattr(NB, k), edge=True) for k in
                 ["dataset_profile", "feature_rows", "rate_by_age", "diagnosis_value_counts",
                  "dominant_subtype", "peak_age", "gender_diagnosis_counts", "family_history_row_pct",
                  "age_histogram", "correlations_with_diagnosis", "correlations"]})
REGISTRY.update({f"{k}_edge": _on_features(getattr(NB, k), edge=True) for k in
                 ["kruskal_lifestyle", "lifestyle_boxes", "group_stats_table", "anova_severity",
                  "chi_square_family", "contingency_family", "severity_density", "chi_square_family_test", "describe_indices", "error_bars", "risk_category_counts"]})


from strata.plans import findings as FI  # noqa: E402
from strata.plans import models as MD  # noqa: E402

REGISTRY.update({k: _on_raw(getattr(MD, k)) for k in
                 ["split_assignment", "split_report", "fold_assignment", "fold_sizes"]})
# the evaluation code on rule predictions, and the parts of the models that SQL can state
_MODEL_CHECKS = ["rule_report", "rule_report_few_classes", "rule_confusion", "rule_cv_accuracy", "rule_comparison",
                 "scaler_statistics", "feature_vectors", "feature_correlation_rank", "split_losses"]
REGISTRY.update({k: _on_raw(getattr(MD, k)) for k in _MODEL_CHECKS})
REGISTRY["split_losses_edge"] = _on_raw(MD.split_losses, edge=True)
REGISTRY["data_findings"] = _on_raw(FI.data_findings)
REGISTRY["split_report_edge"] = _on_raw(MD.split_report, edge=True)
# model reports: fitted with the analysed workload's settings; checked by rows only
REGISTRY.update({k: _on_raw(getattr(MD, k)) for k in
                 ["rf_report", "rf_confusion", "rf_importance", "cv_accuracy", "model_comparison"]})
REGISTRY["key_findings"] = _on_raw(FI.key_findings)
# the same fits with few, shallow trees, a few steps or two features: SQL grows the same models
REGISTRY.update({k: _on_raw(getattr(MD, k)) for k in
                 ["forest_nodes", "forest_predictions", "forest_importance", "cv_accuracy_shallow", "boosting_nodes",
                  "boosting_predictions", "logistic_gradient", "logistic_two_classes"]})


from strata.plans import io_queries as IO  # noqa: E402
from strata.plans import tables as TB  # noqa: E402

REGISTRY["severity_density"] = _on_features(NB.severity_density)
REGISTRY.update({k: _on_raw(getattr(NB, k)) for k in
                 ["gender_value_counts", "family_history_value_counts", "life_stage_value_counts"]})
REGISTRY.update({f"{k}_edge": _on_raw(getattr(NB, k), edge=True) for k in
                 ["gender_value_counts", "family_history_value_counts", "life_stage_value_counts"]})
REGISTRY["screen_outlier_points"] = _on_features(NB.screen_outlier_points)
REGISTRY["severity_violin_quartiles"] = _on_features(NB.severity_violin_quartiles)
REGISTRY["distinct_classes"] = _on_raw(NB.distinct_classes)
REGISTRY.update({k: getattr(IO, k) for k in
                 ["enriched_export", "csv_executive_summary", "peek_rows", "id_key_check",
                  "cleaned_parquet_roundtrip", "appended_keys", "folded_summary"]})
REGISTRY.update({k: getattr(TB, k) for k in
                 ["lineitem_flag_status", "lineitem_price_percentiles", "lineitem_kruskal",
                  "events_value_boxes", "toxic_by_language"]})


def queries() -> dict[str, Query]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    from strata.plans.oracle import QUERIES
    from strata.plans.oracle_more import MORE
    from strata.plans.oracle_notebook import NB_QUERIES
    from strata.plans.oracle_models import MODELS
    both = {**QUERIES, **NB_QUERIES, **MORE, **MODELS}
    return {k: v for k, v in both.items() if k in REGISTRY}
