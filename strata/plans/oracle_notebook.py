"""DuckDB SQL for the notebook-half entries (features, frequencies, charts, tests)."""

from __future__ import annotations

from strata.plans.oracle import R, cohort_sql

DX = ["No ADHD", "Inattentive Type", "Hyperactive Type", "Combined Type"]
SEV = ["Minimal", "Mild", "Moderate", "Severe"]

_H = " + ".join(f"COALESCE(Q1_{j}, 0)" for j in range(1, 10))
_I = " + ".join(f"COALESCE(Q2_{j}, 0)" for j in range(1, 10))


def _d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


_RISK = " + ".join(f"{_d(c)} * {_d(w)}" for c, w in [
    ("Total_Severity", "0.4"), ("Anxiety_Risk", "3.0"), ("Sleep_Risk", "2.5"), ("High_Screen", "2.0"),
    ("Low_Activity", "1.5"), ("High_Caffeine", "1.0")])

LABELLED = """SELECT * EXCLUDE (id),
  CASE Diagnosis_Class WHEN 0 THEN 'No ADHD' WHEN 1 THEN 'Inattentive Type'
    WHEN 2 THEN 'Hyperactive Type' WHEN 3 THEN 'Combined Type' END AS Diagnosis_Label,
  CASE Gender WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' END AS Gender_Label
FROM patients_raw"""

FEATURE_CTES = f"""f0 AS (SELECT *,
  CASE Diagnosis_Class WHEN 0 THEN 'No ADHD' WHEN 1 THEN 'Inattentive Type'
    WHEN 2 THEN 'Hyperactive Type' WHEN 3 THEN 'Combined Type' END AS Diagnosis_Label,
  CASE Gender WHEN 1 THEN 'Male' WHEN 2 THEN 'Female' END AS Gender_Label,
  ({_H}) AS Hyperactivity_Index, ({_I}) AS Inattention_Index
  FROM patients_raw),
f1 AS (SELECT *, Hyperactivity_Index + Inattention_Index AS Total_Severity FROM f0),
f2 AS (SELECT *,
  Hyperactivity_Index / (Total_Severity + CAST(0.001 AS DOUBLE)) AS HI_Dominance_Ratio,
  ABS(Hyperactivity_Index - Inattention_Index) AS Score_Imbalance,
  CASE WHEN Age BETWEEN 3 AND 4 THEN 'Early Childhood' WHEN Age BETWEEN 5 AND 14 THEN 'Pediatric'
       WHEN Age BETWEEN 15 AND 18 THEN 'Adolescent' ELSE 'Adult' END AS Life_Stage,
  CASE WHEN Age BETWEEN 5 AND 6 THEN '5-6 Early' WHEN Age BETWEEN 7 AND 8 THEN '7-8 Young'
       WHEN Age BETWEEN 9 AND 10 THEN '9-10 Mid' WHEN Age BETWEEN 11 AND 12 THEN '11-12 Pre-Teen'
       WHEN Age BETWEEN 13 AND 14 THEN '13-14 Teen' ELSE 'Other' END AS Age_Band,
  CASE WHEN Sleep_Hours < 7 THEN 1 ELSE 0 END AS Sleep_Risk,
  CASE WHEN Daily_Phone_Usage_Hours > 4 THEN 1 ELSE 0 END AS High_Screen,
  CASE WHEN Anxiety_Depression_Levels >= 3 THEN 1 ELSE 0 END AS Anxiety_Risk,
  CASE WHEN Daily_Walking_Running_Hours < 1 THEN 1 ELSE 0 END AS Low_Activity,
  CASE WHEN Daily_Coffee_Tea_Consumption >= 3 THEN 1 ELSE 0 END AS High_Caffeine
  FROM f1),
f3 AS (SELECT *, {_RISK} AS Risk_Score,
  CASE WHEN Total_Severity <= 9 THEN 'Minimal' WHEN Total_Severity <= 22 THEN 'Mild'
       WHEN Total_Severity <= 36 THEN 'Moderate' ELSE 'Severe' END AS Severity_Class,
  CASE Family_History WHEN 'No' THEN 0 WHEN 'Yes' THEN 1 WHEN 'Unknown' THEN 2 END AS Family_History_Enc
  FROM f2),
features AS (SELECT *,
  CASE WHEN Risk_Score IS NULL THEN 'High Risk'
       WHEN Risk_Score <= (SELECT QUANTILE_CONT(Risk_Score, 0.33) FROM f3) THEN 'Low Risk'
       WHEN Risk_Score <= (SELECT QUANTILE_CONT(Risk_Score, 0.66) FROM f3) THEN 'Moderate Risk'
       ELSE 'High Risk' END AS Risk_Category
  FROM f3)"""


def with_features(body: str, edge: bool = False) -> str:
    return (f"WITH patients_raw AS (\n{cohort_sql(edge)}\n),\nlabelled AS (\n{LABELLED}\n),\n"
            f"{FEATURE_CTES}\n{body}")


B: dict[str, str] = {}

B["dataset_profile"] = f"""
SELECT COUNT(*) AS rows, 34 AS columns, MIN(Age) AS min_age, MAX(Age) AS max_age,
  CAST({' + '.join(f'SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)' for c in
       ['Age', 'Gender', 'Educational_Level', 'Family_History', 'Sleep_Hours', 'Daily_Activity_Hours']
       + [f'Q1_{j}' for j in range(1, 10)] + [f'Q2_{j}' for j in range(1, 10)]
       + ['Diagnosis_Class', 'Daily_Phone_Usage_Hours', 'Daily_Walking_Running_Hours',
          'Difficulty_Organizing_Tasks', 'Focus_Score_Video', 'Daily_Coffee_Tea_Consumption',
          'Learning_Difficulties', 'Anxiety_Depression_Levels', 'Diagnosis_Label', 'Gender_Label'])}
    AS BIGINT) AS missing_cells
FROM labelled"""

B["feature_rows"] = "SELECT * FROM features"

B["risk_category_counts"] = "SELECT Risk_Category, COUNT(*) AS count FROM features GROUP BY Risk_Category"

B["severity_class_counts"] = "SELECT Severity_Class, COUNT(*) AS count FROM features GROUP BY Severity_Class"

B["diagnosis_value_counts"] = f"""
SELECT Diagnosis_Label AS value, COUNT(*) AS count,
  {R('100.0 * COUNT(*) / (SELECT COUNT(*) FROM labelled)', 1)} AS share_pct
FROM labelled WHERE Diagnosis_Label IS NOT NULL GROUP BY Diagnosis_Label"""

B["dominant_subtype"] = """
SELECT Diagnosis_Label AS dominant_type, COUNT(*) AS dominant_count,
  CAST(100.0 AS DOUBLE) * COUNT(*) / (SELECT COUNT(*) FROM labelled WHERE Diagnosis_Label IS NOT NULL)
    AS dominant_pct
FROM labelled
WHERE Diagnosis_Label IS NOT NULL AND (Diagnosis_Class IS NULL OR Diagnosis_Class != 0)
GROUP BY Diagnosis_Label ORDER BY COUNT(*) DESC, Diagnosis_Label LIMIT 1"""

_DIAG = "CASE WHEN Diagnosis_Class IS NULL OR Diagnosis_Class != 0 THEN 1 ELSE 0 END"
B["rate_by_age"] = f"""
SELECT Age, COUNT(*) AS total, CAST(SUM({_DIAG}) AS BIGINT) AS adhd_count,
  AVG({_DIAG}) * CAST(100.0 AS DOUBLE) AS prevalence
FROM patients_raw WHERE Age IS NOT NULL GROUP BY Age"""

B["peak_age"] = f"""
SELECT Age AS peak_age, AVG({_DIAG}) * CAST(100.0 AS DOUBLE) AS peak_prevalence
FROM patients_raw WHERE Age IS NOT NULL GROUP BY Age
ORDER BY peak_prevalence DESC, Age LIMIT 1"""


def _pivot_counts(row: str, src: str) -> str:
    cols = ",\n  ".join(f"CAST(SUM(CASE WHEN Diagnosis_Label = '{d}' THEN 1 ELSE 0 END) AS BIGINT) AS \"{d}\""
                        for d in DX)
    return (f"SELECT {row},\n  {cols}\nFROM {src} WHERE {row} IS NOT NULL AND Diagnosis_Label IS NOT NULL "
            f"GROUP BY {row}")


B["gender_diagnosis_counts"] = _pivot_counts("Gender_Label", "labelled")

B["family_history_row_pct"] = "\nSELECT Family_History,\n  " + ",\n  ".join(
    f"CAST(100.0 AS DOUBLE) * SUM(CASE WHEN Diagnosis_Label = '{d}' THEN 1 ELSE 0 END) / COUNT(*) AS \"{d}\""
    for d in DX) + ("\nFROM labelled WHERE Family_History IS NOT NULL AND Diagnosis_Label IS NOT NULL "
                    "GROUP BY Family_History")

_SEV_VALUES = ", ".join(f"('{s}', {i})" for i, s in enumerate(SEV))
B["severity_diagnosis_counts"] = f"""
, wide AS ({_pivot_counts('Severity_Class', 'features')})
SELECT d.Severity_Class, """ + ", ".join(f"COALESCE(w.\"{d}\", 0) AS \"{d}\"" for d in DX) + f"""
FROM (VALUES {_SEV_VALUES}) d(Severity_Class, ord) LEFT JOIN wide w USING (Severity_Class)"""

STAT_COLS = ["Hyperactivity_Index", "Inattention_Index", "Total_Severity", "Sleep_Hours",
             "Daily_Phone_Usage_Hours", "Anxiety_Depression_Levels"]
B["group_stats_table"] = "\nSELECT Diagnosis_Label,\n  " + ",\n  ".join(
    f"{R(f'AVG({c})', 2)} AS {c}_mean, {R(f'STDDEV_SAMP({c})', 2)} AS {c}_std, "
    f"{R(f'MEDIAN({c})', 2)} AS {c}_median" for c in STAT_COLS) + \
    "\nFROM features WHERE Diagnosis_Label IS NOT NULL GROUP BY Diagnosis_Label"

B["describe_indices"] = "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS variable, COUNT({c}) AS count, {R(f'AVG({c})', 2)} AS mean, "
    f"{R(f'STDDEV_SAMP({c})', 2)} AS std, {R(f'MIN({c})', 2)} AS min, "
    f"{R(f'QUANTILE_CONT({c}, 0.25)', 2)} AS p25, {R(f'QUANTILE_CONT({c}, 0.5)', 2)} AS p50, "
    f"{R(f'QUANTILE_CONT({c}, 0.75)', 2)} AS p75, {R(f'MAX({c})', 2)} AS max FROM features"
    for c in ["Hyperactivity_Index", "Inattention_Index", "Total_Severity"])

CORR = ["Age", "Sleep_Hours", "Daily_Phone_Usage_Hours", "Daily_Walking_Running_Hours",
        "Daily_Coffee_Tea_Consumption", "Focus_Score_Video", "Anxiety_Depression_Levels",
        "Learning_Difficulties", "Difficulty_Organizing_Tasks", "Daily_Activity_Hours", "Diagnosis_Class"]


def _corr_sql(lower_only: bool, digits: int) -> str:
    pairs = [(i, j) for i in range(len(CORR)) for j in range(len(CORR)) if (i > j if lower_only else True)]
    calc = ", ".join(f"CORR({CORR[i]}, {CORR[j]}) AS c{i}_{j}" for i, j in pairs if i != j)
    parts = []
    for i, j in pairs:
        v = "CAST(1.0 AS DOUBLE)" if i == j else R(f"c{i}_{j}", digits)
        parts.append(f"SELECT '{CORR[i]}' AS var_x, '{CORR[j]}' AS var_y, {v} AS corr FROM c")
    return f"\n, c AS (SELECT {calc} FROM patients_raw)\n" + "\nUNION ALL\n".join(parts)


B["correlations"] = _corr_sql(False, 6)
B["correlations_lower"] = _corr_sql(True, 2)

B["correlations_with_diagnosis"] = "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS variable, {R(f'CORR({c}, Diagnosis_Class)', 6)} AS corr FROM patients_raw"
    for c in CORR if c != "Diagnosis_Class")

B["age_histogram"] = """
, r AS (SELECT CAST(MIN(Age) AS DOUBLE) AS lo, CAST(MAX(Age) AS DOUBLE) AS hi FROM patients_raw
        WHERE Age IS NOT NULL),
b AS (SELECT CASE WHEN hi - lo > 0 THEN LEAST(CAST(FLOOR((Age - lo) * 30 / (hi - lo)) AS INT), 29)
              ELSE 0 END AS bin
      FROM patients_raw, r WHERE Age IS NOT NULL),
c AS (SELECT bin, COUNT(*) AS count FROM b GROUP BY bin),
fr AS (SELECT CAST(g.range AS INT) AS bin, lo + g.range * ((hi - lo) / 30) AS bin_lo,
         lo + (g.range + 1) * ((hi - lo) / 30) AS bin_hi FROM r, range(30) g)
SELECT fr.bin, bin_lo, bin_hi, COALESCE(c.count, 0) AS count FROM fr LEFT JOIN c USING (bin)"""

B["risk_score_histograms"] = """
, src AS (SELECT Diagnosis_Label, CAST(Risk_Score AS DOUBLE) AS x FROM features
          WHERE Risk_Score IS NOT NULL AND Diagnosis_Label IS NOT NULL),
r AS (SELECT Diagnosis_Label, MIN(x) AS lo, MAX(x) AS hi FROM src GROUP BY Diagnosis_Label),
b AS (SELECT s.Diagnosis_Label,
        CASE WHEN hi - lo > 0 THEN LEAST(CAST(FLOOR((x - lo) * 30 / (hi - lo)) AS INT), 29) ELSE 0 END AS bin
      FROM src s JOIN r USING (Diagnosis_Label)),
c AS (SELECT Diagnosis_Label, bin, COUNT(*) AS count FROM b GROUP BY Diagnosis_Label, bin),
fr AS (SELECT Diagnosis_Label, CAST(g.range AS INT) AS bin, lo + g.range * ((hi - lo) / 30) AS bin_lo,
         lo + (g.range + 1) * ((hi - lo) / 30) AS bin_hi FROM r, range(30) g)
SELECT fr.Diagnosis_Label, fr.bin, bin_lo, bin_hi, COALESCE(c.count, 0) AS count
FROM fr LEFT JOIN c USING (Diagnosis_Label, bin)"""

_DX_VALUES = ", ".join(f"('{d}', {i + 1})" for i, d in enumerate(DX))
B["diagnosis_bars"] = f"""
, c AS (SELECT Diagnosis_Label AS label, COUNT(*) AS count FROM labelled GROUP BY Diagnosis_Label)
SELECT d.label, d.ord, COALESCE(c.count, 0) AS count,
  {R('100.0 * COALESCE(c.count, 0) / (SELECT COUNT(*) FROM labelled)', 1)} AS pct
FROM (VALUES {_DX_VALUES}) d(label, ord) LEFT JOIN c USING (label)"""

BOX_VARS = ["Sleep_Hours", "Daily_Phone_Usage_Hours", "Daily_Walking_Running_Hours",
            "Daily_Coffee_Tea_Consumption", "Anxiety_Depression_Levels", "Focus_Score_Video",
            "HI_Dominance_Ratio"]


def _long(vars_: list[str], src: str, group: str) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT {group}, '{v}' AS variable, CAST({v} AS DOUBLE) AS value FROM {src} "
        f"WHERE {group} IS NOT NULL AND {v} IS NOT NULL" for v in vars_)


B["lifestyle_boxes"] = f"""
, lg AS ({_long(BOX_VARS, 'features', 'Diagnosis_Label')}),
q AS (SELECT variable, Diagnosis_Label, COUNT(*) AS n, QUANTILE_CONT(value, 0.25) AS q1,
        QUANTILE_CONT(value, 0.5) AS median, QUANTILE_CONT(value, 0.75) AS q3
      FROM lg GROUP BY variable, Diagnosis_Label),
fe AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo_fence, q3 + 1.5 * (q3 - q1) AS hi_fence FROM q)
SELECT fe.variable, fe.Diagnosis_Label, fe.n, fe.q1, fe.median, fe.q3,
  MIN(CASE WHEN value BETWEEN lo_fence AND hi_fence THEN value END) AS whisker_lo,
  MAX(CASE WHEN value BETWEEN lo_fence AND hi_fence THEN value END) AS whisker_hi,
  COUNT(CASE WHEN NOT (value BETWEEN lo_fence AND hi_fence) THEN 1 END) AS n_outliers
FROM lg JOIN fe USING (variable, Diagnosis_Label)
GROUP BY fe.variable, fe.Diagnosis_Label, fe.n, fe.q1, fe.median, fe.q3"""

B["error_bars"] = f"""
, lg AS ({_long(['Hyperactivity_Index', 'Inattention_Index', 'Risk_Score'], 'features', 'Diagnosis_Label')})
SELECT Diagnosis_Label, variable AS metric, {R('AVG(value)', 6)} AS mean, {R('STDDEV_SAMP(value)', 6)} AS sd,
  COUNT(value) AS n
FROM lg GROUP BY Diagnosis_Label, variable"""

B["anova_severity"] = f"""
, g AS (SELECT Diagnosis_Label, COUNT(*) AS n, AVG(Total_Severity) AS m, VAR_SAMP(Total_Severity) AS v
        FROM features WHERE Diagnosis_Label IS NOT NULL AND Total_Severity IS NOT NULL
        GROUP BY Diagnosis_Label),
t AS (SELECT COUNT(*) AS k, SUM(n) AS n_all, SUM(n * m) / SUM(n) AS grand FROM g),
s AS (SELECT t.k, t.n_all, SUM(g.n * (g.m - t.grand) * (g.m - t.grand)) AS ssb,
        SUM(COALESCE((g.n - 1) * g.v, 0)) AS ssw
      FROM g, t GROUP BY t.k, t.n_all)
SELECT CAST(k AS BIGINT) AS k, CAST(n_all AS BIGINT) AS n, CAST(k - 1 AS BIGINT) AS df_between,
  CAST(n_all - k AS BIGINT) AS df_within, {R('ssb', 6)} AS ss_between, {R('ssw', 6)} AS ss_within,
  {R('(ssb / (k - 1)) / NULLIF(ssw / (n_all - k), 0)', 6)} AS f_stat
FROM s"""

B["anova_group_lines"] = f"""
SELECT Diagnosis_Label, {R('AVG(Total_Severity)', 2)} AS mean, {R('STDDEV_SAMP(Total_Severity)', 2)} AS sd,
  COUNT(*) AS n
FROM features WHERE Diagnosis_Label IS NOT NULL GROUP BY Diagnosis_Label"""

KW_VARS = ["Sleep_Hours", "Daily_Phone_Usage_Hours", "Daily_Walking_Running_Hours",
           "Anxiety_Depression_Levels", "Focus_Score_Video", "Daily_Coffee_Tea_Consumption"]
B["kruskal_lifestyle"] = f"""
, lg AS ({_long(KW_VARS, 'features', 'Diagnosis_Label')}),
rk AS (SELECT variable, Diagnosis_Label, value,
         RANK() OVER (PARTITION BY variable ORDER BY value)
         + (COUNT(*) OVER (PARTITION BY variable, value) - 1) / 2.0 AS midrank
       FROM lg),
grp AS (SELECT variable, Diagnosis_Label, COUNT(*) AS n, SUM(midrank) AS rs FROM rk
        GROUP BY variable, Diagnosis_Label),
tie AS (SELECT variable, SUM(CAST(t AS DOUBLE) * t * t - t) AS ties, SUM(t) AS n_all
        FROM (SELECT variable, value, COUNT(*) AS t FROM lg GROUP BY variable, value) x GROUP BY variable),
agg AS (SELECT variable, COUNT(*) AS k, SUM(rs * rs / n) AS s FROM grp GROUP BY variable)
SELECT agg.variable, CAST(agg.k AS BIGINT) AS k, CAST(tie.n_all AS BIGINT) AS n,
  {R('(12.0 / (CAST(tie.n_all AS DOUBLE) * (tie.n_all + 1)) * agg.s - 3 * (tie.n_all + 1)) / NULLIF(1 - tie.ties / (CAST(tie.n_all AS DOUBLE) * tie.n_all * tie.n_all - tie.n_all), 0)', 6)} AS h_stat
FROM agg JOIN tie USING (variable)"""

# every pair of the two margins is a cell; a pair that never occurs has 0
_CELLS = """, obs AS (
  SELECT Family_History, Diagnosis_Label FROM features
  WHERE Family_History IS NOT NULL AND Diagnosis_Label IS NOT NULL),
rm AS (SELECT Family_History, COUNT(*) AS row_total FROM obs GROUP BY Family_History),
cm AS (SELECT Diagnosis_Label, COUNT(*) AS col_total FROM obs GROUP BY Diagnosis_Label),
e AS (SELECT rm.Family_History, cm.Diagnosis_Label, row_total, col_total,
        (SELECT COUNT(*) FROM obs) AS n,
        (SELECT COUNT(*) FROM obs o WHERE o.Family_History = rm.Family_History
           AND o.Diagnosis_Label = cm.Diagnosis_Label) AS observed,
        CAST(row_total AS DOUBLE) * col_total / (SELECT COUNT(*) FROM obs) AS expected
      FROM rm, cm)"""

_CHI2 = "SUM((observed - expected) * (observed - expected) / expected)"
B["chi_square_family"] = _CELLS + f"""
SELECT CAST(MAX(n) AS BIGINT) AS n, CAST(COUNT(DISTINCT Family_History) AS BIGINT) AS n_rows,
  CAST(COUNT(DISTINCT Diagnosis_Label) AS BIGINT) AS n_cols,
  CAST((COUNT(DISTINCT Family_History) - 1) * (COUNT(DISTINCT Diagnosis_Label) - 1) AS BIGINT) AS dof,
  {R(_CHI2, 6)} AS chi2
FROM e"""

B["contingency_family"] = _CELLS + f"""
SELECT Family_History, Diagnosis_Label, CAST(observed AS BIGINT) AS observed, {R('expected', 6)} AS expected
FROM e"""

# Tails by Simpson's rule in u = sqrt(s) over the integrals of functions/pvalues.py: another
# rule and another variable than the Spark side. Gamma at half-integers is a product.
_NODES = 20000


def _simpson(f: str, upper: float) -> str:
    """int_0^upper f(u) du; f is SQL over the lambda variable u."""
    h = upper / _NODES
    return (f"(list_sum(list_transform(range(0, {_NODES + 1}), lambda i: (CASE WHEN i = 0 OR i = {_NODES} THEN 1 "
            f"WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({f.replace('$u', f'(i * {h!r})')}))) * {h!r} / 3)")


def _gamma_half(n: str) -> str:
    """Gamma(n / 2) for an integer n >= 1."""
    return (f"(CASE WHEN {n} % 2 = 0 THEN 1.0 ELSE SQRT(PI()) END * list_product(list_transform(range(0, 60), "
            f"lambda j: CASE WHEN (2 - {n} % 2) / 2.0 + j < {n} / 2.0 - 0.25 THEN (2 - {n} % 2) / 2.0 + j ELSE 1.0 END)))")


def chi2_tail(x: str, k: str) -> str:
    half, a = f"(({x}) / 2.0)", f"({k} / 2.0)"
    inner = _simpson(f"2 * $u * EXP(-$u * $u) * POWER(1 + $u * $u / {half}, {a} - 1)", 8.0)
    return f"LEAST(POWER({half}, {a} - 1) * EXP(-{half}) / {_gamma_half(k)} * {inner}, 1.0)"


def f_tail(f: str, d1: str, d2: str) -> str:
    """For d2 so large that Gamma(a + b) / Gamma(a) = a^b (1 + b(b-1)/2a + ...) to three terms."""
    a, b, spread = f"({d2} / 2.0)", f"({d1} / 2.0)", f"LN(1 + {d1} * ({f}) / {d2})"
    ratio = (f"POWER({a}, {b}) * (1 + {b} * ({b} - 1) / (2 * {a}) + {b} * ({b} - 1) * ({b} - 2) * (3 * {b} - 1) / (24 * {a} * {a}) "
             f"+ {b} * {b} * ({b} - 1) * ({b} - 1) * ({b} - 2) * ({b} - 3) / (48 * {a} * {a} * {a}))")
    inner = _simpson(f"2 * $u * EXP(-$u * $u) * POWER(1 - EXP(-({spread} + $u * $u / {a})), {b} - 1)", 8.0)
    return f"LEAST(EXP(-{a} * {spread}) / {a} * {ratio} / {_gamma_half(d1)} * {inner}, 1.0)"


_YES = "CASE WHEN p_value < 0.05 THEN 'YES' ELSE 'NO' END AS significant"


def _tested(name: str, tail: str, digits: int = 9, more: str = "") -> str:
    """The statistics of ``name`` with a tail over their rounded values."""
    head, _, last = B[name].rpartition("\nSELECT ")
    return (f"{head}, st AS (SELECT {last}), tp AS (SELECT *, {R(tail, digits)} AS p_value FROM st)\n"
            f"SELECT *, {_YES}{more} FROM tp")


B["anova_severity_test"] = _tested("anova_severity", f_tail("f_stat", "df_between", "df_within"))
B["kruskal_lifestyle_test"] = _tested("kruskal_lifestyle", chi2_tail("h_stat", "(k - 1)"),
                                      more=f", k - 1 AS dof, {R('h_stat', 2)} AS h_stat_2dp")
B["chi_square_family_test"] = _tested("chi_square_family", chi2_tail("chi2", "dof"))

NB_QUERIES: dict[str, str] = {k: with_features(v) for k, v in B.items()}
NB_EDGE_KEYS = ["dataset_profile", "feature_rows", "rate_by_age", "kruskal_lifestyle", "lifestyle_boxes",
                "diagnosis_value_counts", "dominant_subtype", "peak_age", "gender_diagnosis_counts",
                "family_history_row_pct", "age_histogram", "group_stats_table", "anova_severity",
                "chi_square_family", "contingency_family", "chi_square_family_test", "correlations_with_diagnosis", "correlations", "describe_indices",
                "error_bars", "risk_category_counts"]
NB_QUERIES.update({f"{k}_edge": with_features(B[k], edge=True) for k in NB_EDGE_KEYS})

_FEATS = ["Age", "Gender", "Sleep_Hours", "Daily_Phone_Usage_Hours", "Daily_Walking_Running_Hours",
          "Daily_Activity_Hours", "Daily_Coffee_Tea_Consumption", "Anxiety_Depression_Levels",
          "Focus_Score_Video", "Learning_Difficulties", "Difficulty_Organizing_Tasks", "Hyperactivity_Index",
          "Inattention_Index", "Total_Severity", "HI_Dominance_Ratio", "Score_Imbalance", "Risk_Score",
          "Sleep_Risk", "High_Screen", "Anxiety_Risk", "Low_Activity", "Family_History_Enc"]
_RANKED = """
, mf AS (SELECT id, Diagnosis_Class AS class FROM features
         WHERE Diagnosis_Class IS NOT NULL AND """ + " AND ".join(f"{c} IS NOT NULL" for c in _FEATS) + """),
ranked AS (SELECT id, class,
  ROW_NUMBER() OVER (PARTITION BY class ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id) AS rn,
  COUNT(*) OVER (PARTITION BY class) AS class_n FROM mf)"""
_PART = "CASE WHEN rn <= ROUND(class_n * 0.2) THEN 'test' ELSE 'train' END"

MODEL_B = {
    "split_assignment": _RANKED + f"\nSELECT id, class, {_PART} AS part FROM ranked",
    "split_report": _RANKED + f"\nSELECT {_PART} AS part, class, COUNT(*) AS n FROM ranked GROUP BY 1, 2",
    "fold_assignment": _RANKED + "\nSELECT id, class, CAST(NTILE(5) OVER (PARTITION BY class ORDER BY rn) - 1 AS INT) AS fold FROM ranked",
    "fold_sizes": _RANKED + "\nSELECT fold, class, COUNT(*) AS n FROM (SELECT class, "
                            "CAST(NTILE(5) OVER (PARTITION BY class ORDER BY rn) - 1 AS INT) AS fold FROM ranked) f GROUP BY 1, 2",
}
_RULES = {"Balance rule": "CASE WHEN Hyperactivity_Index - Inattention_Index > 3 THEN 2 WHEN Inattention_Index - "
                          "Hyperactivity_Index > 3 THEN 1 WHEN Total_Severity >= 30 THEN 3 ELSE 0 END",
          "Severity rule": "CASE WHEN Total_Severity >= 36 THEN 3 WHEN Total_Severity >= 27 THEN 2 "
                           "WHEN Total_Severity >= 20 THEN 1 ELSE 0 END",
          "Never class 3": "CASE WHEN Total_Severity >= 27 THEN 2 ELSE 0 END"}
_FRAME = _RANKED + ", fr AS (SELECT f.*, r.rn, r.class_n, " + _PART + " AS part FROM features f JOIN ranked r ON f.id = r.id)"


def _report(rule: str, where: str) -> str:
    return _FRAME + f"""
, p AS (SELECT Diagnosis_Class AS a, {_RULES[rule]} AS p FROM fr WHERE {where}),
cl AS (SELECT a AS c FROM p UNION SELECT p FROM p),
per AS (
  SELECT c, (SELECT COUNT(*) FROM p WHERE a = c AND p = c) AS tp, (SELECT COUNT(*) FROM p WHERE p = c) AS pp,
    (SELECT COUNT(*) FROM p WHERE a = c) AS support FROM cl),
m AS (SELECT *, CASE WHEN pp > 0 THEN CAST(tp AS DOUBLE) / pp ELSE 0.0 END AS precision,
        CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS recall FROM per),
q AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m)
SELECT CASE c WHEN 0 THEN 'No ADHD' WHEN 1 THEN 'Inattentive Type' WHEN 2 THEN 'Hyperactive Type'
    WHEN 3 THEN 'Combined Type' END AS class, precision, recall, f1, CAST(support AS BIGINT) AS support FROM q
UNION ALL SELECT 'accuracy', NULL, NULL, CAST(SUM(tp) AS DOUBLE) / SUM(support), CAST(SUM(support) AS BIGINT) FROM q
UNION ALL SELECT 'macro avg', AVG(precision), AVG(recall), AVG(f1), CAST(SUM(support) AS BIGINT) FROM q
UNION ALL SELECT 'weighted avg', SUM(precision * support) / SUM(support), SUM(recall * support) / SUM(support),
  SUM(f1 * support) / SUM(support), CAST(SUM(support) AS BIGINT) FROM q"""


MODEL_B["rule_report"] = _report("Balance rule", "TRUE")
MODEL_B["rule_report_few_classes"] = _report("Never class 3", "Diagnosis_Class IN (0, 1)")
MODEL_B["rule_confusion"] = _FRAME + f"""
, p AS (SELECT CAST(Diagnosis_Class AS INT) AS actual, {_RULES['Balance rule']} AS p FROM fr)
SELECT actual, {', '.join(f'COUNT(CASE WHEN p = {c} THEN 1 END) AS pred_{c}' for c in range(4))},
  {', '.join(f'CAST(100.0 AS DOUBLE) * COUNT(CASE WHEN p = {c} THEN 1 END) / COUNT(*) AS pct_{c}' for c in range(4))}
FROM p GROUP BY actual"""
MODEL_B["rule_cv_accuracy"] = _FRAME + f"""
, p AS (SELECT Diagnosis_Class AS a, {_RULES['Balance rule']} AS p,
          CAST(NTILE(5) OVER (PARTITION BY Diagnosis_Class ORDER BY rn) - 1 AS INT) AS fold FROM fr),
per AS (SELECT fold, COUNT(*) AS n, AVG(CASE WHEN a = p THEN 1.0 ELSE 0.0 END) AS accuracy FROM p GROUP BY fold)
SELECT fold, n, accuracy, AVG(accuracy) OVER () AS mean_accuracy, STDDEV_POP(accuracy) OVER () AS std_accuracy FROM per"""
MODEL_B["rule_comparison"] = _FRAME + ", acc AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS model, {i} AS pos, AVG(CASE WHEN Diagnosis_Class = {r} THEN 1.0 ELSE 0.0 END) AS accuracy, COUNT(*) AS n "
    f"FROM fr WHERE part = 'test'" for i, (n, r) in enumerate(_RULES.items())) + """)
SELECT model, accuracy, n, pos = (SELECT arg_min(pos, (-accuracy, pos)) FROM acc) AS best FROM acc"""
MODEL_B["scaler_statistics"] = _FRAME + "\n" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, AVG(CAST({c} AS DOUBLE)) AS mean, STDDEV_POP(CAST({c} AS DOUBLE)) AS sd FROM fr WHERE part = 'train'"
    for c in _FEATS)
MODEL_B["feature_vectors"] = _FRAME + "\nSELECT id, CAST(Diagnosis_Class AS DOUBLE) AS label, " + ", ".join(
    f"CAST({c} AS DOUBLE) AS f{i}_{c}" for i, c in enumerate(_FEATS)) + " FROM fr"
_ENGINEERED = ["Hyperactivity_Index", "Inattention_Index", "Total_Severity", "HI_Dominance_Ratio", "Score_Imbalance",
               "Risk_Score", "Sleep_Risk", "High_Screen", "Anxiety_Risk", "Low_Activity"]
MODEL_B["feature_correlation_rank"] = _FRAME + ", c AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {R(f'COALESCE(ABS(CORR({c}, Diagnosis_Class)), 0)', 9)} AS importance FROM fr" for c in _FEATS) + f""")
SELECT feature, importance, feature IN ({', '.join(repr(c) for c in _ENGINEERED)}) AS engineered,
  AVG(importance) OVER () AS mean_importance, CAST(ROW_NUMBER() OVER (ORDER BY importance DESC, feature) AS INT) AS rank,
  ROW_NUMBER() OVER (ORDER BY importance DESC, feature) <= 10 AS top FROM c"""
MODEL_B["split_losses"] = _RANKED + """
SELECT (SELECT COUNT(*) FROM features) AS rows, (SELECT COUNT(*) FROM ranked) AS used,
  (SELECT COUNT(*) FROM features) - (SELECT COUNT(*) FROM ranked) AS dropped"""


def _counts(col: str, src: str) -> str:
    return f"""
SELECT {col} AS value, COUNT(*) AS count, {R(f'100.0 * COUNT(*) / (SELECT COUNT(*) FROM {src})', 1)} AS share_pct
FROM {src} WHERE {col} IS NOT NULL GROUP BY {col}"""


for _name, _col, _src in (("gender", "Gender_Label", "labelled"), ("family_history", "Family_History", "patients_raw"),
                          ("life_stage", "Life_Stage", "features")):
    MODEL_B[f"{_name}_value_counts"] = _counts(_col, _src)
    NB_QUERIES[f"{_name}_value_counts_edge"] = with_features(MODEL_B[f"{_name}_value_counts"], edge=True)

MODEL_B["screen_outlier_points"] = """
, x AS (SELECT id, Diagnosis_Label, POWER(Daily_Phone_Usage_Hours, 3) AS value FROM features
        WHERE Diagnosis_Label IS NOT NULL AND Daily_Phone_Usage_Hours IS NOT NULL),
q AS (SELECT Diagnosis_Label, QUANTILE_CONT(value, 0.25) AS q1, QUANTILE_CONT(value, 0.75) AS q3 FROM x GROUP BY Diagnosis_Label)
SELECT x.id, x.Diagnosis_Label, x.value FROM x JOIN q USING (Diagnosis_Label)
WHERE value < q1 - 0.5 * (q3 - q1) OR value > q3 + 0.5 * (q3 - q1)"""
MODEL_B["severity_violin_quartiles"] = """
SELECT Diagnosis_Label, COUNT(*) AS n, CAST(QUANTILE_CONT(Total_Severity, 0.25) AS DOUBLE) AS q1,
  CAST(QUANTILE_CONT(Total_Severity, 0.5) AS DOUBLE) AS median, CAST(QUANTILE_CONT(Total_Severity, 0.75) AS DOUBLE) AS q3
FROM features WHERE Diagnosis_Label IS NOT NULL AND Total_Severity IS NOT NULL GROUP BY Diagnosis_Label"""
MODEL_B["data_findings"] = f"""
, dom AS ({B['dominant_subtype']}), pk AS ({B['peak_age']})
SELECT (SELECT COUNT(*) FROM patients_raw) AS patients,
  (SELECT AVG({_DIAG}) * CAST(100.0 AS DOUBLE) FROM patients_raw) AS adhd_prevalence_pct,
  dominant_type, dominant_pct, peak_age,
  ({{anova}}) AS anova_significant, ({{chi}}) AS chi_square_significant FROM dom, pk"""
NB_QUERIES.update({k: with_features(v) for k, v in MODEL_B.items() if k != "data_findings"})
# the verdicts as scalar subqueries over the two test queries
NB_QUERIES["data_findings"] = with_features(MODEL_B["data_findings"].format(
    anova=f"SELECT significant FROM ({with_features(B['anova_severity_test'])}) t1",
    chi=f"SELECT significant FROM ({with_features(B['chi_square_family_test'])}) t2"))
NB_QUERIES["split_losses_edge"] = with_features(MODEL_B["split_losses"], edge=True)
NB_QUERIES["split_report_edge"] = with_features(MODEL_B["split_report"], edge=True)
