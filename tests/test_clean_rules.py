"""Edge rows with hand-computed expectations (FIXTURES.md §4)."""


from strata.operators.clean import clean, features
from strata.sources import schema as S


def _row(id_, **kw):
    base = {c: 1 for c in S.Q1_COLS + S.Q2_COLS}
    base.update({"id": id_, "Age": 10.0, "Gender": 1, "Educational_Level": "x", "Family_History": "No",
                 "Sleep_Hours": 8.0, "Daily_Activity_Hours": 1.0, "Diagnosis_Class": 0,
                 "Daily_Phone_Usage_Hours": 1.0, "Daily_Walking_Running_Hours": 2.0,
                 "Difficulty_Organizing_Tasks": 0, "Focus_Score_Video": 1.0,
                 "Daily_Coffee_Tea_Consumption": 0.0, "Learning_Difficulties": 0,
                 "Anxiety_Depression_Levels": 0})
    base.update(kw)
    return tuple(base[c] for c in S.RAW_COLUMNS)


def _df(spark, rows):
    return spark.createDataFrame(rows, S.RAW_SCHEMA)


def _by_id(df, col):
    return {r["id"]: r[col] for r in df.select("id", col).collect()}


def test_life_stage_and_band_sql_rule(spark):
    ages = [3, 4, 5, 14, 15, 18, 19, 55, 2, 4.5, 56, None]
    raw = _df(spark, [_row(i, Age=None if a is None else float(a)) for i, a in enumerate(ages)])
    c = clean(raw)
    stage = _by_id(c, "Life_Stage")
    assert [stage[i] for i in range(len(ages))] == [
        "Early Childhood (3-4)", "Early Childhood (3-4)", "Pediatric (5-14)", "Pediatric (5-14)",
        "Adolescent (15-18)", "Adolescent (15-18)", "Adult (19-55)", "Adult (19-55)", None, None, None, None]
    band = _by_id(c, "Age_Band")
    assert band[2] == "5-6 Early" and band[3] == "13-14 Teen" and band[9] is None and band[0] is None


def test_life_stage_and_band_notebook_rule(spark):
    ages = [3, 5, 15, 19, 2, 4.5, 56, None]
    raw = _df(spark, [_row(i, Age=None if a is None else float(a)) for i, a in enumerate(ages)])
    f = features(raw)
    stage = _by_id(f, "Life_Stage")
    assert [stage[i] for i in range(len(ages))] == [
        "Early Childhood", "Pediatric", "Adolescent", "Adult", "Adult", "Adult", "Adult", "Adult"]
    band = _by_id(f, "Age_Band")
    assert band[1] == "5-6 Early" and band[5] == "Other" and band[7] == "Other"


def test_missing_item_propagates_or_skips(spark):
    raw = _df(spark, [_row(1, Q1_3=None)])
    c = clean(raw).collect()[0]
    assert c["Hyperactivity_Index"] is None and c["Inattention_Index"] == 9 and c["Total_Severity"] is None
    f = features(raw).collect()[0]
    assert f["Hyperactivity_Index"] == 8 and f["Inattention_Index"] == 9 and f["Total_Severity"] == 17


def test_flag_limits(spark):
    rows = [_row(1, Sleep_Hours=7.0, Daily_Phone_Usage_Hours=4.0, Anxiety_Depression_Levels=3,
                 Daily_Walking_Running_Hours=1.0, Daily_Coffee_Tea_Consumption=3.0),
            _row(2, Sleep_Hours=6.9, Daily_Phone_Usage_Hours=4.1, Anxiety_Depression_Levels=2,
                 Daily_Walking_Running_Hours=0.9, Daily_Coffee_Tea_Consumption=2.9),
            _row(3, Sleep_Hours=None)]
    raw = _df(spark, rows)
    c = {r["id"]: r for r in clean(raw).collect()}
    assert (c[1]["Sleep_Risk_Flag"], c[1]["High_Screen_Flag"], c[1]["Anxiety_Risk_Flag"]) == (0, 0, 1)
    assert (c[2]["Sleep_Risk_Flag"], c[2]["High_Screen_Flag"], c[2]["Anxiety_Risk_Flag"]) == (1, 1, 0)
    assert c[3]["Sleep_Risk_Flag"] == 0
    f = {r["id"]: r for r in features(raw).collect()}
    assert (f[1]["Low_Activity"], f[1]["High_Caffeine"]) == (0, 1)
    assert (f[2]["Low_Activity"], f[2]["High_Caffeine"]) == (1, 0)


def test_gender_and_class_labels(spark):
    raw = _df(spark, [_row(1, Gender=1, Diagnosis_Class=0), _row(2, Gender=2, Diagnosis_Class=3),
                      _row(3, Gender=9, Diagnosis_Class=9), _row(4, Gender=None, Diagnosis_Class=None)])
    c = {r["id"]: r for r in clean(raw).collect()}
    assert [c[i]["Gender"] for i in (1, 2, 3, 4)] == ["Male", "Female", "Female", "Female"]
    assert [c[i]["Diagnosis_Label"] for i in (1, 2, 3, 4)] == ["No ADHD", "Combined Type", None, None]
    f = {r["id"]: r for r in features(raw).collect()}
    assert [f[i]["Gender_Label"] for i in (1, 2, 3, 4)] == ["Male", "Female", None, None]


def test_severity_class_bounds(spark):
    from strata.functions.labels import severity_class
    df = spark.createDataFrame([(t,) for t in (9, 10, 22, 23, 36, 37)], "Total_Severity int")
    got = [r[0] for r in df.select(severity_class()).collect()]
    assert got == ["Minimal", "Mild", "Mild", "Moderate", "Moderate", "Severe"]


def test_risk_rule_all_flag_combinations(spark):
    from strata.functions.labels import risk_rule
    combos = ["111", "110", "101", "011", "100", "010", "001", "000"]
    df = spark.createDataFrame([tuple(int(ch) for ch in c) for c in combos],
                               "Sleep_Risk_Flag int, High_Screen_Flag int, Anxiety_Risk_Flag int")
    got = [r[0] for r in df.select(risk_rule()).collect()]
    assert got == ["Critical Risk", "High Risk", "Moderate Risk", "Moderate Risk", "Moderate Risk",
                   "Moderate Risk", "Low Risk", "Low Risk"]


def test_composite_score_and_dominance(spark):
    # total 20: H 10, I 10 (items: 10 ones spread as 1s plus one 2 ...)
    q = {c: 0 for c in S.Q1_COLS + S.Q2_COLS}
    q.update({"Q1_1": 3, "Q1_2": 3, "Q1_3": 3, "Q1_4": 1, "Q2_1": 3, "Q2_2": 3, "Q2_3": 3, "Q2_4": 1})
    all_flags = _row(1, Sleep_Hours=5.0, Daily_Phone_Usage_Hours=5.0, Anxiety_Depression_Levels=4,
                     Daily_Walking_Running_Hours=0.0, Daily_Coffee_Tea_Consumption=4.0, **q)
    no_flags = _row(2, **q)
    zero = _row(3, **{c: 0 for c in S.Q1_COLS + S.Q2_COLS})
    f = {r["id"]: r for r in features(_df(spark, [all_flags, no_flags, zero]), with_quantile_risk=False).collect()}
    assert abs(f[1]["Risk_Score"] - 18.0) < 1e-12 and abs(f[2]["Risk_Score"] - 8.0) < 1e-12
    assert f[3]["HI_Dominance_Ratio"] == 0.0
    assert abs(f[1]["HI_Dominance_Ratio"] - 10 / 20.001) < 1e-15


def test_rolling_rows_not_years(spark):
    from strata.plans.queries import prevalence_by_age_rolling
    # rates 10, 20, 60, 30 at ages 5, 6, 7, 9 (10 rows per age)
    rows, i = [], 0
    for age, pos in [(5, 1), (6, 2), (7, 6), (9, 3)]:
        for k in range(10):
            rows.append(_row(i, Age=float(age), Diagnosis_Class=1 if k < pos else 0))
            i += 1
    out = prevalence_by_age_rolling(_df(spark, rows)).collect()
    assert [r["rolling_3yr_prevalence"] for r in out] == [10.0, 15.0, 30.0, 36.7]
    assert [r["cumulative_patients"] for r in out] == [10, 20, 30, 40]


def test_zscore_zero_spread_and_single_row(spark):
    from strata.plans.queries import severity_rank_outliers
    zero = {c: 0 for c in S.Q1_COLS + S.Q2_COLS}
    rows = [_row(1, Diagnosis_Class=1, **{**zero, "Q1_1": 3, "Q1_2": 2}),
            _row(2, Diagnosis_Class=1, **{**zero, "Q1_1": 3, "Q1_2": 2}),
            _row(3, Diagnosis_Class=2, **zero)]
    out = {r["id"]: r for r in severity_rank_outliers(clean(_df(spark, rows))).collect()}
    assert out[1]["z_score"] is None and out[1]["outlier_flag"] == "Normal" and out[1]["severity_rank"] == 1
    assert out[3]["z_score"] is None and out[3]["severity_rank"] == 1


def test_rank_ties(spark):
    from strata.operators.windows import rank_by_score
    df = spark.createDataFrame([(1, "a", 10), (2, "a", 10), (3, "a", 8), (4, "b", None), (5, "b", 3)],
                               "id int, g string, s int")
    got = {r["id"]: r["rank"] for r in rank_by_score(df, ["g"], "s").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1, 5: 2}


def test_stage_counts_include_null_and_sum_to_total(spark, sf_small):
    from strata.plans.queries import life_stage_overview
    from strata.sources.cohort import patients_raw
    c = clean(patients_raw(spark, sf_small, edge=True))
    rows = life_stage_overview(c).collect()
    assert any(r["Life_Stage"] is None for r in rows)
    assert sum(r["patients"] for r in rows) == c.count()
    assert abs(sum(r["pct_of_total"] for r in rows) - 100) <= 0.05 * len(rows)
