"""CSV reader, export round trip, key check."""

import tempfile

from pyspark.sql import functions as F

from strata.operators.clean import clean
from strata.plans import queries as Q
from strata.sources import schema as S
from strata.sources.cohort import patients_raw, read_questionnaire_csv
from strata.sources.sinks import key_check, write_csv


def test_csv_round_trip_equals_direct(spark, sf_small):
    raw = patients_raw(spark, sf_small, edge=True)
    path = tempfile.mkdtemp(prefix="strata-test-csv-") + "/cohort"
    write_csv(raw.select(*S.CSV_SCHEMA.fieldNames()), path)
    back = read_questionnaire_csv(spark, path)
    assert back.count() == raw.count()
    # blanks come back as NULL, never NaN
    assert back.where(F.isnan("Sleep_Hours")).count() == 0
    assert back.where(F.col("Sleep_Hours").isNull()).count() == raw.where(F.col("Sleep_Hours").isNull()).count()
    a = Q.executive_summary(clean(back)).collect()
    b = Q.executive_summary(clean(raw)).collect()
    assert a == b


def test_csv_na_markers(spark):
    path = tempfile.mkdtemp(prefix="strata-test-na-") + "/f.csv"
    header = ",".join(S.CSV_SCHEMA.fieldNames())
    vals = ["10", "1", "NA", "Yes", "", "1"] + ["1"] * 18 + ["0", "1", "1", "0", "1", "1", "0", "2"]
    with open(path, "w") as fh:
        fh.write(header + "\n" + ",".join(vals) + "\n")
    r = read_questionnaire_csv(spark, path).collect()[0]
    assert r["Educational_Level"] is None and r["Sleep_Hours"] is None and r["Family_History"] == "Yes"


def test_csv_numeric_na_markers_and_bad_values(spark):
    import pytest
    header = ",".join(S.CSV_SCHEMA.fieldNames())
    ok = ["NA", "null", "x", "Yes", "7.5", "None"] + ["1"] * 18 + ["N/A", "1", "1", "0", "1", "1", "0", "2"]
    bad = ["ten", "1", "x", "Yes", "7.5", "1"] + ["1"] * 18 + ["0", "1", "1", "0", "1", "1", "0", "2"]
    base = tempfile.mkdtemp(prefix="strata-test-na2-")
    for name, vals in (("ok", ok), ("bad", bad)):
        with open(f"{base}/{name}.csv", "w") as fh:
            fh.write(header + "\n" + ",".join(vals) + "\n")
    r = read_questionnaire_csv(spark, f"{base}/ok.csv").collect()[0]
    assert r["Age"] is None and r["Gender"] is None and r["Sleep_Hours"] == 7.5
    assert r["Daily_Activity_Hours"] is None and r["Diagnosis_Class"] is None and r["Q1_1"] == 1
    with pytest.raises(Exception):
        read_questionnaire_csv(spark, f"{base}/bad.csv").collect()


def _file(vals_rows, path):
    with open(path, "w") as fh:
        fh.write(",".join(S.CSV_SCHEMA.fieldNames()) + "\n" + "".join(",".join(v) + "\n" for v in vals_rows))
    return path


def _cells(**over):
    base = dict(zip(S.CSV_SCHEMA.fieldNames(), ["10", "1", "Primary", "Yes", "7.5", "1"] + ["1"] * 18
                    + ["0", "1", "1", "0", "1", "1", "0", "2"]))
    return [{**base, **over}[c] for c in S.CSV_SCHEMA.fieldNames()]


def test_notebook_and_sql_rules(spark):
    import pytest
    base = tempfile.mkdtemp(prefix="strata-test-rules-")
    path = _file([_cells(Educational_Level=" Primary ", Family_History="n/a", Gender="2.0", Sleep_Hours="nan", Age=" 11 ",
                         Daily_Activity_Hours="#N/A", Q1_1="<NA>", Diagnosis_Class="")], f"{base}/a.csv")
    r = read_questionnaire_csv(spark, path).first()
    assert (r.Educational_Level, r.Family_History, r.Gender, r.Sleep_Hours, r.Age) == (" Primary ", None, 2, None, 11.0)
    assert (r.Daily_Activity_Hours, r.Q1_1, r.Diagnosis_Class) == (None, None, None)
    with pytest.raises(Exception):
        read_questionnaire_csv(spark, path, rules="sql").collect()
    path = _file([_cells(Educational_Level="NA", Family_History="", Sleep_Hours="")], f"{base}/b.csv")
    r = read_questionnaire_csv(spark, path, rules="sql").first()
    assert (r.Educational_Level, r.Family_History, r.Sleep_Hours) == ("NA", None, None)
    path = _file([_cells(Gender="1.5")], f"{base}/c.csv")
    with pytest.raises(Exception):
        read_questionnaire_csv(spark, path).collect()


def test_surrogate_key_is_dense_and_independent_of_splits(spark, sf_small):
    path = tempfile.mkdtemp(prefix="strata-test-key-") + "/cohort"
    rows = patients_raw(spark, sf_small).select(*S.CSV_SCHEMA.fieldNames())
    write_csv(rows.union(rows.limit(50)).repartition(5), path)
    a = read_questionnaire_csv(spark, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        n = a.count()
        assert a.agg(F.min("id"), F.max("id"), F.countDistinct("id")).first() == (1, n, n)
        a = sorted(map(tuple, a.collect()))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
        b = sorted(map(tuple, read_questionnaire_csv(spark, path).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert a == b


def test_key_check(spark, sf_small):
    r = key_check(patients_raw(spark, sf_small), "id").collect()[0]
    assert r["rows"] == r["distinct_keys"] and r["duplicate_keys"] == 0
    dup = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    r = key_check(dup, "id").collect()[0]
    assert (r["rows"], r["distinct_keys"], r["duplicate_keys"]) == (3, 2, 1)


def test_quoted_cells_round_trip(spark, sf_small, tmp_path):
    """Quotes, backslashes, commas, white space and line breaks come back as they were."""
    from strata.sources.sinks import read_csv_as
    cells = ['say "hi" now', '"', 'a,b', 'ends in \\', '\\"', " padded ", "line\nbreak", 'x"\n"y', "'", "tab\there"]
    base = patients_raw(spark, sf_small).orderBy("id").limit(len(cells)).select(*S.CSV_SCHEMA.fieldNames())
    rows = [dict(r.asDict(), Educational_Level=c) for r, c in zip(base.collect(), cells)]
    df = spark.createDataFrame([tuple(r[c] for c in base.columns) for r in rows], base.schema)
    path = write_csv(df, f"{tmp_path}/cells")
    back = read_questionnaire_csv(spark, path, multi_line=True)
    assert sorted(r["Educational_Level"] for r in back.collect()) == sorted(cells)
    assert sorted(r["Educational_Level"] for r in read_csv_as(spark, path, df.schema, multi_line=True).collect()) == sorted(cells)


def test_doubled_quotes_and_backslashes_in_a_file(spark, sf_small, tmp_path):
    """A file as a database server or pandas writes it, read split by split."""
    import csv
    cells = ['say "hi" now', "ends in \\", "a,b", 'mid"quote']
    rows = patients_raw(spark, sf_small).orderBy("id").limit(len(cells)).select(*S.CSV_SCHEMA.fieldNames())
    with open(tmp_path / "cells.csv", "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(rows.columns)
        for r, c in zip(rows.collect(), cells):
            out.writerow([c if name == "Educational_Level" else r[name] for name in rows.columns])
    back = read_questionnaire_csv(spark, str(tmp_path / "cells.csv"))
    assert sorted(r["Educational_Level"] for r in back.collect()) == sorted(cells)
