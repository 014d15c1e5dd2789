"""The streaming summary equals the batch summary over the same files."""

import tempfile

from strata.operators.clean import clean
from strata.plans.queries import executive_summary
from strata.sources import schema as S
from strata.sources.cohort import patients_raw
from strata.sources.sinks import write_csv
from strata.streaming.incremental import start_summary_stream


def test_stream_matches_batch(spark, sf_small):
    raw = patients_raw(spark, sf_small)
    base = tempfile.mkdtemp(prefix="strata-test-stream-")
    inp = f"{base}/in"
    halves = raw.randomSplit([0.5, 0.5], seed=1)
    write_csv(halves[0].select(*S.CSV_SCHEMA.fieldNames()), f"{inp}/a")
    write_csv(halves[1].select(*S.CSV_SCHEMA.fieldNames()), f"{inp}/b")
    q = start_summary_stream(spark, f"{inp}/*", f"{base}/out", checkpoint=f"{base}/ckpt")
    q.awaitTermination(300)
    got = spark.read.parquet(f"{base}/out").drop("batch_id")
    exp = executive_summary(clean(raw))
    key = "Life_Stage"
    a = sorted(got.collect(), key=lambda r: r[key])
    b = sorted(exp.collect(), key=lambda r: r[key])
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def test_stream_reader_types_cells_like_batch(spark):
    import os

    from strata.sources.cohort import read_questionnaire_csv
    from strata.streaming.incremental import read_questionnaire_stream
    base = tempfile.mkdtemp(prefix="strata-test-stream-na-")
    os.makedirs(f"{base}/in")
    header = ",".join(S.CSV_SCHEMA.fieldNames())
    vals = ["NA", "1", "x", "Yes", "6.5", "1"] + ["1"] * 18 + ["null", "1", "1", "0", "1", "1", "0", "2"]
    with open(f"{base}/in/f.csv", "w") as fh:
        fh.write(header + "\n" + ",".join(vals) + "\n")
    q = (read_questionnaire_stream(spark, f"{base}/in").writeStream.format("memory")
         .queryName("na_stream").trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = spark.sql("SELECT * FROM na_stream").drop("id").collect()[0]
    exp = read_questionnaire_csv(spark, f"{base}/in/f.csv").drop("id").collect()[0]
    assert got == exp and got["Age"] is None and got["Diagnosis_Class"] is None
