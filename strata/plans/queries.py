"""The analytic query set over the cleaned cohort, one function per query.

Each function takes the cleaned DataFrame (``operators.clean.clean``) or, for the
age-prevalence query, the raw table, and returns a lazy DataFrame with every column
named. NULL ordering follows the analysed SQL dialect: ascending sorts put NULL last,
descending ones first. Hidden sort keys are aggregated under a private name, used
for the sort and dropped.

Scale notes: every query is one scan of the cohort, a filter that Catalyst pushes
into the scan where it touches stored columns, one hash aggregate with partial
aggregation, and windows only over the aggregated rows (a few dozen at most).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strata.functions import labels as L
from strata.functions.scores import pct
from strata.operators.metrics import cond_mean, count_if, mean_pct, rate_pct, rmean, share
from strata.sources import schema as S


def _adhd():
    """Diagnosed: class differs from 0 (a NULL class counts as not diagnosed)."""
    return F.col("Diagnosis_Class") != 0


def _pediatric():
    return F.col("Age").between(5, 14)


def _asc(c):
    return F.asc_nulls_last(c)


def cohort_overview(clean: DataFrame) -> DataFrame:
    """Whole-cohort counts, age range, prevalence and gender split (one row)."""
    return clean.agg(
        F.count(F.lit(1)).alias("total_patients"),
        F.round(F.avg("Age"), 1).alias("avg_age"),
        F.min("Age").alias("min_age"),
        F.max("Age").alias("max_age"),
        count_if(_adhd()).alias("total_adhd"),
        rate_pct(_adhd()).alias("overall_prevalence_pct"),
        count_if(F.col("Gender") == "Male").alias("male_count"),
        count_if(F.col("Gender") == "Female").alias("female_count"),
    )


def life_stage_overview(clean: DataFrame) -> DataFrame:
    """Per life stage (NULL stage kept): size, share of all, prevalence, mean severity;
    youngest stage first."""
    agg = clean.groupBy("Life_Stage").agg(
        F.count(F.lit(1)).alias("patients"),
        count_if(_adhd()).alias("adhd_count"),
        rate_pct(_adhd()).alias("adhd_prevalence_pct"),
        rmean("Total_Severity").alias("avg_total_severity"),
        F.min("Age").alias("_min_age"))
    agg = share(agg, "patients", name="pct_of_total")
    return (agg.orderBy(_asc("_min_age"))
            .select("Life_Stage", "patients", "pct_of_total", "adhd_count",
                    "adhd_prevalence_pct", "avg_total_severity"))


def diagnosis_distribution(clean: DataFrame, pediatric_only: bool = False) -> DataFrame:
    """Per diagnosis: count and share; the full version adds mean indices."""
    src = clean.where(_pediatric()) if pediatric_only else clean
    extra = [] if pediatric_only else [
        rmean("Total_Severity").alias("avg_severity"),
        rmean("Hyperactivity_Index").alias("avg_hyperactivity"),
        rmean("Inattention_Index").alias("avg_inattention")]
    agg = src.groupBy("Diagnosis_Label", "Diagnosis_Class").agg(
        F.count(F.lit(1)).alias("patient_count"), *extra)
    agg = share(agg, "patient_count", name="percentage")
    cols = ["Diagnosis_Label", "patient_count", "percentage"] + (
        [] if pediatric_only else ["avg_severity", "avg_hyperactivity", "avg_inattention"])
    return agg.orderBy(_asc("Diagnosis_Class")).select(*cols)


def prevalence_by_age_rolling(raw: DataFrame, lo: int = 5, hi: int = 18, span: int = 3) -> DataFrame:
    """Prevalence per age with a trailing mean over ``span`` age rows (of the unrounded
    rates) and a running patient count. Reads the raw table, as the SQL does.

    The two windows are unpartitioned but run over one row per distinct age."""
    by_age = (raw.where(F.col("Age").between(lo, hi)).groupBy("Age").agg(
        F.count(F.lit(1)).alias("total_patients"),
        count_if(_adhd()).alias("adhd_count"),
        rate_pct(_adhd(), None).alias("_rate")))
    trailing = Window.orderBy(_asc("Age")).rowsBetween(-(span - 1), Window.currentRow)
    running = Window.orderBy(_asc("Age")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (by_age.select(
        "Age", "total_patients", "adhd_count",
        F.round("_rate", 1).alias("prevalence_pct"),
        F.round(F.avg("_rate").over(trailing), 1).alias("rolling_3yr_prevalence"),
        F.sum("total_patients").over(running).cast("bigint").alias("cumulative_patients"))
        .orderBy(_asc("Age")))


def life_stage_comparison(clean: DataFrame) -> DataFrame:
    """Per (stage, diagnosis): size and nine lifestyle means."""
    agg = clean.where(F.col("Life_Stage").isNotNull()).groupBy(
        "Life_Stage", "Diagnosis_Label", "Diagnosis_Class").agg(
        F.count(F.lit(1)).alias("n"),
        rmean("Total_Severity").alias("avg_severity"),
        rmean("Sleep_Hours").alias("avg_sleep"),
        rmean("Daily_Phone_Usage_Hours").alias("avg_screen_time"),
        rmean("Daily_Walking_Running_Hours").alias("avg_activity"),
        rmean("Daily_Coffee_Tea_Consumption").alias("avg_caffeine"),
        rmean("Focus_Score_Video").alias("avg_focus_score"),
        rmean("Anxiety_Depression_Levels").alias("avg_anxiety"),
        rmean("Learning_Difficulties").alias("avg_learning_diff"),
        rmean("Difficulty_Organizing_Tasks").alias("avg_org_difficulty"))
    return agg.orderBy(_asc("Life_Stage"), _asc("Diagnosis_Class")).drop("Diagnosis_Class")


def risk_stratification(clean: DataFrame) -> DataFrame:
    """Pediatric rows -> rule-based risk category -> summary per (diagnosis, risk) ->
    share within diagnosis; critical first."""
    flagged = clean.where(_pediatric()).withColumn("Risk_Category", L.risk_rule())
    summary = flagged.groupBy("Diagnosis_Label", "Risk_Category").agg(
        F.count(F.lit(1)).alias("patient_count"),
        rmean("Total_Severity").alias("avg_severity"),
        rmean("Sleep_Hours").alias("avg_sleep"),
        rmean("Daily_Phone_Usage_Hours").alias("avg_screen_time"),
        rmean("Anxiety_Depression_Levels").alias("avg_anxiety"),
        count_if(F.col("Family_History") == "Yes").alias("family_history_count"))
    out = share(summary, "patient_count", within=["Diagnosis_Label"], name="pct_within_diagnosis")
    risk_order = L.order_key("Risk_Category", S.RISK_RULE_ORDER[:3], rest=4)
    return out.orderBy(_asc("Diagnosis_Label"), risk_order)


def percentile_table(clean: DataFrame) -> DataFrame:
    """Per diagnosis: mean, sample sd and exact interpolated quartiles of the indices.

    One ``percentile`` aggregate per column returns all its cut points at once, so each
    column keeps one value->count map per group (tiny for integer scores)."""
    h = F.percentile("Hyperactivity_Index", [0.25, 0.5, 0.75])
    i = F.percentile("Inattention_Index", [0.25, 0.5, 0.75])
    t = F.percentile("Total_Severity", [0.5, 0.9])
    agg = clean.groupBy("Diagnosis_Label", "Diagnosis_Class").agg(
        F.count(F.lit(1)).alias("n"),
        rmean("Hyperactivity_Index").alias("mean_hyperactivity"),
        F.round(F.stddev_samp("Hyperactivity_Index"), 2).alias("sd_hyperactivity"),
        h.alias("_h"),
        rmean("Inattention_Index").alias("mean_inattention"),
        F.round(F.stddev_samp("Inattention_Index"), 2).alias("sd_inattention"),
        i.alias("_i"),
        rmean("Total_Severity").alias("mean_total_severity"),
        t.alias("_t"))
    return agg.orderBy(_asc("Diagnosis_Class")).select(
        "Diagnosis_Label", "n", "mean_hyperactivity", "sd_hyperactivity",
        F.col("_h")[0].alias("p25_hyperactivity"), F.col("_h")[1].alias("median_hyperactivity"),
        F.col("_h")[2].alias("p75_hyperactivity"),
        "mean_inattention", "sd_inattention",
        F.col("_i")[0].alias("p25_inattention"), F.col("_i")[1].alias("median_inattention"),
        F.col("_i")[2].alias("p75_inattention"),
        "mean_total_severity",
        F.col("_t")[0].alias("median_total_severity"), F.col("_t")[1].alias("p90_total_severity"))


def sleep_buckets(clean: DataFrame) -> DataFrame:
    """Pediatric rows per (diagnosis, sleep bucket): count and mean severity."""
    agg = (clean.where(_pediatric())
           .select("Diagnosis_Label", "Diagnosis_Class", "Total_Severity",
                   L.sleep_bucket().alias("Sleep_Category"), L.sleep_order().alias("Sleep_Order"))
           .groupBy("Diagnosis_Label", "Diagnosis_Class", "Sleep_Category", "Sleep_Order")
           .agg(F.count(F.lit(1)).alias("patient_count"), rmean("Total_Severity").alias("avg_severity")))
    return (agg.orderBy(_asc("Diagnosis_Class"), _asc("Sleep_Order"))
            .select("Diagnosis_Label", "Sleep_Category", "patient_count", "avg_severity"))


def screen_buckets(clean: DataFrame) -> DataFrame:
    """Pediatric rows per screen-time bucket, ordered by the bucket's mean screen time."""
    agg = (clean.where(_pediatric()).withColumn("Screen_Time_Bucket", L.screen_bucket())
           .groupBy("Screen_Time_Bucket").agg(
               F.count(F.lit(1)).alias("total_patients"),
               rmean("Total_Severity").alias("avg_severity"),
               rmean("Anxiety_Depression_Levels").alias("avg_anxiety"),
               count_if(_adhd()).alias("adhd_count"),
               rate_pct(_adhd()).alias("adhd_prevalence_pct"),
               F.avg("Daily_Phone_Usage_Hours").alias("_order")))
    return agg.orderBy(_asc("_order")).drop("_order")


def family_history_impact(clean: DataFrame) -> DataFrame:
    """Pediatric rows per (family history, diagnosis): means and share within history."""
    agg = clean.where(_pediatric()).groupBy("Family_History", "Diagnosis_Label", "Diagnosis_Class").agg(
        F.count(F.lit(1)).alias("patient_count"),
        rmean("Total_Severity").alias("avg_severity"),
        rmean("Hyperactivity_Index").alias("avg_hyperactivity"),
        rmean("Inattention_Index").alias("avg_inattention"),
        rmean("Anxiety_Depression_Levels").alias("avg_anxiety"))
    agg = share(agg, "patient_count", within=["Family_History"], name="pct_within_group")
    return agg.orderBy(_asc("Family_History"), _asc("Diagnosis_Class")).drop("Diagnosis_Class")


def executive_summary(clean: DataFrame) -> DataFrame:
    """One row per (non-NULL) life stage: size, prevalence, subtype counts, means rounded
    to one place and family-history share; stages in age order."""
    base = clean.where(F.col("Life_Stage").isNotNull()).groupBy("Life_Stage").agg(
        F.count(F.lit(1)).alias("total_patients"),
        count_if(_adhd()).alias("adhd_total"),
        count_if(F.col("Diagnosis_Class") == 1).alias("inattentive_count"),
        count_if(F.col("Diagnosis_Class") == 2).alias("hyperactive_count"),
        count_if(F.col("Diagnosis_Class") == 3).alias("combined_count"),
        rmean("Total_Severity", 1).alias("avg_severity"),
        rmean("Sleep_Hours", 1).alias("avg_sleep"),
        rmean("Daily_Phone_Usage_Hours", 1).alias("avg_screen_time"),
        rmean("Anxiety_Depression_Levels", 1).alias("avg_anxiety"),
        count_if(F.col("Family_History") == "Yes").alias("family_history_yes"))
    stage_order = L.order_key("Life_Stage", [s[2] for s in S.LIFE_STAGES])
    return (base.orderBy(F.asc_nulls_last(stage_order)).select(
        "Life_Stage", "total_patients",
        pct("adhd_total", "total_patients").alias("adhd_prevalence_pct"),
        "inattentive_count", "hyperactive_count", "combined_count",
        "avg_severity", "avg_sleep", "avg_screen_time", "avg_anxiety",
        pct("family_history_yes", "total_patients").alias("family_history_pct")))


def comorbidity_matrix(clean: DataFrame) -> DataFrame:
    """Pediatric rows per diagnosis: single risk-factor rates and co-occurrence rates."""
    s, h, a = (F.col("Sleep_Risk_Flag") == 1, F.col("High_Screen_Flag") == 1,
               F.col("Anxiety_Risk_Flag") == 1)
    agg = clean.where(_pediatric()).groupBy("Diagnosis_Label", "Diagnosis_Class").agg(
        mean_pct("Sleep_Risk_Flag").alias("pct_sleep_risk"),
        mean_pct("High_Screen_Flag").alias("pct_high_screen"),
        mean_pct("Anxiety_Risk_Flag").alias("pct_anxiety_risk"),
        mean_pct("Learning_Difficulties").alias("pct_learning_diff"),
        mean_pct("Difficulty_Organizing_Tasks").alias("pct_org_difficulty"),
        rate_pct(s & h).alias("pct_sleep_AND_screen"),
        rate_pct(s & a).alias("pct_sleep_AND_anxiety"),
        rate_pct(s & h & a).alias("pct_all_three_risks"))
    return agg.orderBy(_asc("Diagnosis_Class")).drop("Diagnosis_Class")


def gender_prevalence(clean: DataFrame) -> DataFrame:
    """Pediatric rows per (gender, diagnosis): count, share within gender, means."""
    agg = clean.where(_pediatric()).groupBy("Gender", "Diagnosis_Label", "Diagnosis_Class").agg(
        F.count(F.lit(1)).alias("patient_count"),
        rmean("Total_Severity").alias("avg_severity"),
        rmean("Hyperactivity_Index").alias("avg_hyperactivity"),
        rmean("Inattention_Index").alias("avg_inattention"))
    agg = share(agg, "patient_count", within=["Gender"], name="pct_within_gender")
    return (agg.orderBy(_asc("Gender"), _asc("Diagnosis_Class"))
            .select("Gender", "Diagnosis_Label", "patient_count", "pct_within_gender",
                    "avg_severity", "avg_hyperactivity", "avg_inattention"))


def gender_gap(clean: DataFrame) -> DataFrame:
    """Pediatric mean severity of males and females per diagnosis and their gap."""
    male = cond_mean("Total_Severity", F.col("Gender") == "Male")
    female = cond_mean("Total_Severity", F.col("Gender") == "Female")
    agg = clean.where(_pediatric()).groupBy("Diagnosis_Label", "Diagnosis_Class").agg(
        F.round(male, 2).alias("avg_severity_male"),
        F.round(female, 2).alias("avg_severity_female"),
        F.round(male - female, 2).alias("severity_gap_M_minus_F"))
    return agg.orderBy(_asc("Diagnosis_Class")).drop("Diagnosis_Class")


def education_rank(clean: DataFrame) -> DataFrame:
    """Per education level: prevalence, means and rank by unrounded prevalence
    (highest first, gaps on ties)."""
    agg = clean.groupBy("Educational_Level").agg(
        F.count(F.lit(1)).alias("total"),
        count_if(_adhd()).alias("adhd_count"),
        rate_pct(_adhd()).alias("adhd_prevalence_pct"),
        rmean("Total_Severity").alias("avg_severity"),
        rmean("Focus_Score_Video").alias("avg_focus"),
        rmean("Learning_Difficulties").alias("avg_learning_diff"),
        rate_pct(_adhd(), None).alias("_rate"))
    ranked = agg.withColumn(
        "prevalence_rank",
        F.rank().over(Window.orderBy(F.desc_nulls_first("_rate"))).cast("bigint"))
    return ranked.orderBy(F.desc_nulls_first("adhd_prevalence_pct")).drop("_rate")


def severity_quartile(clean: DataFrame, k: int = 4) -> DataFrame:
    """Pediatric rows with their severity quartile within the diagnosis (``NTILE``),
    ordered by severity (NULL last) and then ``id`` so tied scores split the same way
    every time. Exact and spread over (diagnosis, score, id-range) buckets."""
    from strata.operators.windows import ntile
    ped = clean.where(_pediatric()).select("id", "Diagnosis_Label", "Total_Severity")
    return ntile(ped, k, ["Diagnosis_Label"], "Total_Severity", "id", name="severity_quartile")


def severity_rank_outliers(clean: DataFrame, top: int = 5, z_limit: float = S.OUTLIER_Z) -> DataFrame:
    """Pediatric patients ranked by severity within their diagnosis class (highest
    first, gaps on ties), with the z-score against the class mean and sd; keeps the
    top ``top`` ranks and every ``|z| > z_limit`` outlier.

    Rank, z and the outlier flag depend only on (class, score), so they are computed on
    the (class, score) histogram. Class statistics and the histogram come from one
    grouping-sets aggregate (one scan, one shuffle of partial aggregates); the
    qualifying (class, score) pairs are then joined back to the rows.
    """
    from strata.functions.scores import outlier_label, zscore
    from strata.operators.joins import join_small, materialize
    cols = ["id", "Age", "Gender", "Diagnosis_Label", "Total_Severity", "Hyperactivity_Index",
            "Inattention_Index", "Sleep_Hours", "Daily_Phone_Usage_Hours", "Anxiety_Depression_Levels"]
    ped = clean.where(_pediatric() & F.col("Diagnosis_Class").isNotNull())
    keys = ["Diagnosis_Class", "Diagnosis_Label"]
    both = ped.groupingSets([keys + ["Total_Severity"], keys], *keys, "Total_Severity").agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"),
        F.avg("Total_Severity").alias("mean_sev"), F.stddev_samp("Total_Severity").alias("std_sev"))
    both = materialize(both, "sev-hist")  # read twice below (stats, histogram): one scan
    stats = both.where(F.col("gid") == 1).select("Diagnosis_Class", "mean_sev", "std_sev")
    hist = both.where(F.col("gid") == 0).select("Diagnosis_Class", "Total_Severity", "n")
    before = (Window.partitionBy("Diagnosis_Class").orderBy(F.desc_nulls_first("Total_Severity"))
              .rowsBetween(Window.unboundedPreceding, -1))
    ranked = hist.withColumn("severity_rank",
                             (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1).cast("bigint"))
    z = zscore("Total_Severity", "mean_sev", "std_sev")
    pairs = (ranked.join(stats, "Diagnosis_Class")
             .select("Diagnosis_Class", "Total_Severity", "severity_rank",
                     F.round(z, 2).alias("z_score"), outlier_label(z, z_limit).alias("outlier_flag"))
             .where((F.col("severity_rank") <= top) | (F.col("outlier_flag") == "Outlier")))
    rows = ped.select("Diagnosis_Class", *cols)
    out = join_small(rows, pairs, ["Diagnosis_Class", "Total_Severity"], null_safe=True)
    return (out.orderBy(_asc("Diagnosis_Label"), _asc("severity_rank"))
            .select(*cols, "severity_rank", "z_score", "outlier_flag"))
