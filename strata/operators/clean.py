"""The cleaned view (SQL rules) and the engineered feature table (notebook rules).

Both are pure projections of the raw table: no shuffle, fully pipelined inside one
whole-stage-codegen span, so they cost one scan however large the input is. The one
exception is the quantile-cut risk category, whose two cut-offs come from a single
scalar subquery (one aggregate, broadcast to the tasks as a literal; no join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strata.functions import labels as L
from strata.functions import scores as SC
from strata.sources import schema as S


def clean(raw: DataFrame, missing: str = "propagate") -> DataFrame:
    """Labels, indices, bands and flags of the SQL cleaned view (24 columns, in order).

    ``missing='propagate'`` keeps the SQL rule (a missing item makes the index NULL);
    ``'skip'`` sums the answered items only.
    """
    hyper = SC.row_sum(S.Q1_COLS, missing)
    inatt = SC.row_sum(S.Q2_COLS, missing)
    total = SC.row_sum(S.Q1_COLS + S.Q2_COLS, missing)
    return raw.select(
        "id", "Age",
        L.gender_sql().alias("Gender"),
        "Educational_Level", "Family_History", "Sleep_Hours", "Daily_Activity_Hours",
        hyper.alias("Hyperactivity_Index"),
        inatt.alias("Inattention_Index"),
        total.alias("Total_Severity"),
        L.diagnosis_label().alias("Diagnosis_Label"),
        "Diagnosis_Class",
        L.life_stage(variant="sql").alias("Life_Stage"),
        L.age_band(variant="sql").alias("Age_Band"),
        "Daily_Phone_Usage_Hours", "Daily_Walking_Running_Hours", "Difficulty_Organizing_Tasks",
        "Focus_Score_Video", "Daily_Coffee_Tea_Consumption", "Learning_Difficulties",
        "Anxiety_Depression_Levels",
        SC.flag(F.col("Sleep_Hours") < S.SLEEP_RISK_BELOW).alias("Sleep_Risk_Flag"),
        SC.flag(F.col("Daily_Phone_Usage_Hours") > S.HIGH_SCREEN_ABOVE).alias("High_Screen_Flag"),
        SC.flag(F.col("Anxiety_Depression_Levels") >= S.ANXIETY_RISK_AT_LEAST).alias("Anxiety_Risk_Flag"),
    )


def quantile_cut(df: DataFrame, col: str, probs=tuple(S.RISK_QUANTILES),
                 labels=tuple(S.RISK_QUANTILE_LABELS), name: str = "Risk_Category",
                 method: str = "histogram", accuracy: int = 10000) -> DataFrame:
    """Label each row by where ``col`` falls among its own column quantiles.

    ``x <= q[0]`` -> labels[0], ``x <= q[1]`` -> labels[1], ... else the last label.
    The cut-offs are one scalar subquery over the same column: a single global
    aggregate (partial on every task, one tiny merge), shipped to the tasks as a
    literal, with no join and nothing collected by the caller. ``method='exact'`` uses
    Spark's ``percentile`` (one value map, right for scores with few distinct values);
    ``'histogram'`` is exact and spread over tasks for continuous columns; ``'approx'``
    uses ``percentile_approx``.
    """
    if len(labels) != len(probs) + 1:
        raise ValueError("need one label more than cut points")
    if method == "histogram":
        from strata.operators.windows import histogram_percentiles
        cuts = histogram_percentiles(df, col, [], list(probs)).select("q").scalar()
    else:
        agg = (F.percentile(col, list(probs)) if method == "exact"
               else F.percentile_approx(col, list(probs), accuracy).cast("array<double>"))
        cuts = df.select(agg.alias("q")).scalar()
    x = F.col(col)
    # the repeated subquery reference runs one job (AQE's subquery cache)
    expr = F.when(x.isNull(), F.lit(labels[-1]))
    for i, lab in enumerate(labels[:-1]):
        expr = expr.when(x <= cuts[i], F.lit(lab))
    return df.withColumn(name, expr.otherwise(F.lit(labels[-1])))


def features(raw: DataFrame, missing: str = "skip", with_quantile_risk: bool = True) -> DataFrame:
    """Notebook feature table: raw columns + labels, indices, ratio, bands, five flags,
    composite score, quantile risk category, severity class and encoded family history."""
    hyper = SC.row_sum(S.Q1_COLS, missing)
    inatt = SC.row_sum(S.Q2_COLS, missing)
    base = raw.select(
        "*",
        L.diagnosis_label().alias("Diagnosis_Label"),
        L.gender_label().alias("Gender_Label"),
        hyper.alias("Hyperactivity_Index"),
        inatt.alias("Inattention_Index"),
    )
    h, i = F.col("Hyperactivity_Index"), F.col("Inattention_Index")
    base = base.withColumn("Total_Severity", h + i)
    flags = {
        "Sleep_Risk": F.col("Sleep_Hours") < S.SLEEP_RISK_BELOW,
        "High_Screen": F.col("Daily_Phone_Usage_Hours") > S.HIGH_SCREEN_ABOVE,
        "Anxiety_Risk": F.col("Anxiety_Depression_Levels") >= S.ANXIETY_RISK_AT_LEAST,
        "Low_Activity": F.col("Daily_Walking_Running_Hours") < S.LOW_ACTIVITY_BELOW,
        "High_Caffeine": F.col("Daily_Coffee_Tea_Consumption") >= S.HIGH_CAFFEINE_AT_LEAST,
    }
    out = base.withColumns({
        "HI_Dominance_Ratio": SC.guarded_ratio(h, "Total_Severity", S.DOMINANCE_EPS),
        "Score_Imbalance": SC.abs_diff(h, i),
        "Life_Stage": L.life_stage(variant="notebook"),
        "Age_Band": L.age_band(variant="notebook"),
        **{name: SC.flag(cond) for name, cond in flags.items()},
    })
    out = out.withColumns({
        "Risk_Score": SC.weighted_sum(S.RISK_WEIGHTS),
        "Severity_Class": L.severity_class(),
        "Family_History_Enc": L.family_history_code(),
    })
    if with_quantile_risk:
        # the score is a weighted sum of item counts and half hours: a value map of a few thousand
        # entries, whatever the number of rows
        out = quantile_cut(out, "Risk_Score", method="exact")
    return out
