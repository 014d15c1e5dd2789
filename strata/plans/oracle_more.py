"""DuckDB SQL for the load/export round trips, the density grid and the entries on
the driver's other tables."""

from __future__ import annotations

from strata.plans.oracle import BODIES, R, with_cohort
from strata.plans.oracle_notebook import with_features

EXPORT = ["Age", "Gender_Label", "Educational_Level", "Family_History", "Sleep_Hours",
          "Daily_Phone_Usage_Hours", "Daily_Walking_Running_Hours", "Daily_Coffee_Tea_Consumption",
          "Anxiety_Depression_Levels", "Focus_Score_Video", "Learning_Difficulties",
          "Difficulty_Organizing_Tasks", "Hyperactivity_Index", "Inattention_Index", "Total_Severity",
          "HI_Dominance_Ratio", "Score_Imbalance", "Risk_Score", "Sleep_Risk", "High_Screen",
          "Anxiety_Risk", "Life_Stage", "Age_Band", "Severity_Class", "Risk_Category",
          "Diagnosis_Class", "Diagnosis_Label"]

MORE: dict[str, str] = {}

_DENSITY = f"""
, src AS (SELECT Diagnosis_Label AS g, CAST(Total_Severity AS DOUBLE) AS x FROM features
          WHERE Total_Severity IS NOT NULL AND Diagnosis_Label IS NOT NULL),
st AS (SELECT g, COUNT(*) AS n, MIN(x) AS lo, MAX(x) AS hi,
         STDDEV_SAMP(x) * POWER(CAST(COUNT(*) AS DOUBLE), -0.2) AS h FROM src GROUP BY g),
st2 AS (SELECT *, lo - 2.0 * h AS g0, (hi - lo + 4.0 * h) / 99 AS step FROM st WHERE h > 0),
hist AS (SELECT g, x, COUNT(*) AS c FROM src GROUP BY g, x),
grid AS (SELECT g, CAST(r.range AS INT) AS i, g0 + r.range * step AS gx, n, h FROM st2, range(100) r)
SELECT grid.g AS Diagnosis_Label, i, {R('gx', 6)} AS x,
  {R('SUM(c * EXP(-0.5 * ((gx - x) / h) * ((gx - x) / h))) / (n * h * 2.5066282746310002)', 6)} AS density
FROM grid JOIN hist USING (g) GROUP BY grid.g, i, gx, n, h
UNION ALL SELECT g, 0, {R('lo', 6)}, NULL FROM st WHERE h IS NULL OR h <= 0"""
MORE["severity_density"] = with_features(_DENSITY)
MORE["severity_density_edge"] = with_features(_DENSITY, edge=True)

MORE["distinct_classes"] = with_features(
    "SELECT DISTINCT Diagnosis_Class FROM patients_raw WHERE Diagnosis_Class IS NOT NULL")

MORE["enriched_export"] = with_features("SELECT " + ", ".join(EXPORT) + " FROM features")

MORE["csv_executive_summary"] = with_cohort(BODIES["executive_summary"])

MORE["folded_summary"] = MORE["csv_executive_summary"]

MORE["appended_keys"] = with_cohort("""
SELECT CAST(load AS INT) AS load, rows, rows AS distinct_keys, CAST(upto - rows + 1 AS BIGINT) AS first_key, CAST(upto AS BIGINT) AS last_key
FROM (SELECT load, rows, SUM(rows) OVER (ORDER BY load) AS upto
      FROM (SELECT id % 3 + 1 AS load, COUNT(*) AS rows FROM patients_raw GROUP BY id % 3) a) b""")

MORE["peek_rows"] = with_cohort("SELECT * FROM patients_raw ORDER BY id LIMIT 10")

MORE["id_key_check"] = with_cohort("""
SELECT CAST(SUM(c) AS BIGINT) AS rows, COUNT(*) AS distinct_keys,
  COUNT(CASE WHEN c > 1 THEN 1 END) AS duplicate_keys
FROM (SELECT id, COUNT(*) AS c FROM patients_raw GROUP BY id) k""")

MORE["cleaned_parquet_roundtrip"] = with_cohort(BODIES["comorbidity_matrix"])

MORE["lineitem_flag_status"] = f"""
SELECT l_returnflag, l_linestatus, COUNT(*) AS lines,
  CAST(SUM(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS discounted,
  {R('100.0 * SUM(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) / COUNT(*)', 1)} AS discounted_pct,
  {R('100.0 * COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY l_returnflag)', 1)} AS pct_of_flag
FROM lineitem GROUP BY l_returnflag, l_linestatus"""

MORE["lineitem_price_percentiles"] = "SELECT l_linestatus, COUNT(*) AS n, " + ", ".join(
    f"{R(f'QUANTILE_CONT(l_extendedprice, {p})', 6)} AS {name}"
    for p, name in [(0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.9, "p90")]) + \
    " FROM lineitem GROUP BY l_linestatus"

_LI = "\nUNION ALL\n".join(
    f"SELECT l_returnflag AS grp, '{v}' AS variable, CAST({v} AS DOUBLE) AS value FROM lineitem "
    f"WHERE l_returnflag IS NOT NULL AND {v} IS NOT NULL" for v in ["l_extendedprice", "l_quantity", "l_discount"])
MORE["lineitem_kruskal"] = f"""
WITH lg AS ({_LI}),
rk AS (SELECT variable, grp, value,
         RANK() OVER (PARTITION BY variable ORDER BY value)
         + (COUNT(*) OVER (PARTITION BY variable, value) - 1) / 2.0 AS midrank FROM lg),
g AS (SELECT variable, grp, COUNT(*) AS n, SUM(midrank) AS rs FROM rk GROUP BY variable, grp),
tie AS (SELECT variable, SUM(CAST(t AS DOUBLE) * t * t - t) AS ties, SUM(t) AS n_all
        FROM (SELECT variable, value, COUNT(*) AS t FROM lg GROUP BY variable, value) x GROUP BY variable),
agg AS (SELECT variable, COUNT(*) AS k, SUM(rs * rs / n) AS s FROM g GROUP BY variable)
SELECT agg.variable, CAST(agg.k AS BIGINT) AS k, CAST(tie.n_all AS BIGINT) AS n,
  {R('(12.0 / (CAST(tie.n_all AS DOUBLE) * (tie.n_all + 1)) * agg.s - 3 * (tie.n_all + 1)) / NULLIF(1 - tie.ties / (CAST(tie.n_all AS DOUBLE) * tie.n_all * tie.n_all - tie.n_all), 0)', 6)} AS h_stat
FROM agg JOIN tie USING (variable)"""

MORE["events_value_boxes"] = f"""
WITH lg AS (SELECT event_type, 'value' AS variable, CAST(value AS DOUBLE) AS value FROM events
            WHERE event_type IS NOT NULL AND value IS NOT NULL),
q AS (SELECT variable, event_type, COUNT(*) AS n, QUANTILE_CONT(value, 0.25) AS q1,
        QUANTILE_CONT(value, 0.5) AS median, QUANTILE_CONT(value, 0.75) AS q3
      FROM lg GROUP BY variable, event_type),
fe AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo_fence, q3 + 1.5 * (q3 - q1) AS hi_fence FROM q)
SELECT fe.variable, fe.event_type, fe.n, {R('fe.q1', 6)} AS q1, {R('fe.median', 6)} AS median,
  {R('fe.q3', 6)} AS q3,
  {R('MIN(CASE WHEN value BETWEEN lo_fence AND hi_fence THEN value END)', 6)} AS whisker_lo,
  {R('MAX(CASE WHEN value BETWEEN lo_fence AND hi_fence THEN value END)', 6)} AS whisker_hi,
  COUNT(CASE WHEN NOT (value BETWEEN lo_fence AND hi_fence) THEN 1 END) AS n_outliers
FROM lg JOIN fe USING (variable, event_type)
GROUP BY fe.variable, fe.event_type, fe.n, fe.q1, fe.median, fe.q3"""

MORE["toxic_by_language"] = f"""
SELECT lang, COUNT(*) AS labelled, CAST(SUM(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS toxic,
  {R('100.0 * SUM(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) / COUNT(*)', 1)} AS toxic_pct
FROM documents d JOIN labels l USING (doc_id) GROUP BY lang"""
