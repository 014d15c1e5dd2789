"""The key-findings row: prevalence, dominant subtype, peak age, test verdicts, best
model and top feature, each computed from the data (never fixed text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strata.operators.clean import features
from strata.plans import models as MD
from strata.plans import notebook as NB


def data_findings(raw: DataFrame) -> DataFrame:
    """The findings that need no model, in one row of scalar subqueries (no join)."""
    feat = features(raw)
    diagnosed = F.col("Diagnosis_Class").isNull() | (F.col("Diagnosis_Class") != 0)
    base = raw.agg((F.avg(diagnosed.cast("double")) * F.lit(100.0)).alias("adhd_prevalence_pct"),
                   F.count(F.lit(1)).alias("patients"))
    dom = NB.dominant_subtype(raw)
    return base.select(
        "patients", "adhd_prevalence_pct",
        dom.select("dominant_type").scalar().alias("dominant_type"),
        dom.select("dominant_pct").scalar().alias("dominant_pct"),
        NB.peak_age(raw).select("peak_age").scalar().alias("peak_age"),
        NB.anova_severity_test(feat).select("significant").scalar().alias("anova_significant"),
        NB.chi_square_family_test(feat).select("significant").scalar().alias("chi_square_significant"))


def key_findings(raw: DataFrame, settings: MD.TreeSettings = MD.TreeSettings()) -> DataFrame:
    """One row: the data findings, the best model and the top feature."""
    best = MD.model_comparison(raw, settings).where(F.col("best"))
    top = MD.rf_importance(raw, settings).where(F.col("rank") == 1)
    return data_findings(raw).select(
        "*", best.select("model").scalar().alias("best_model"),
        (best.select("accuracy").scalar() * F.lit(100.0)).alias("best_accuracy_pct"),
        top.select("feature").scalar().alias("top_feature"))
