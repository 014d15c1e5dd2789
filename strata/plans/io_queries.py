"""Load / export round trips: the questionnaire CSV reader and the enriched export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strata.operators.clean import clean, features
from strata.plans import queries as Q
from strata.sources import schema as S
from strata.sources.appends import AppendedTable, SummaryStore
from strata.sources.cohort import patients_raw, peek, read_questionnaire_csv
from strata.sources.sinks import key_check, read_csv_as, shared_scratch, write_csv, write_parquet

EXPORT_TYPES = {"Gender_Label": "string", "Educational_Level": "string", "Family_History": "string",
                "Life_Stage": "string", "Age_Band": "string", "Severity_Class": "string",
                "Risk_Category": "string", "Diagnosis_Label": "string", "HI_Dominance_Ratio": "double",
                "Risk_Score": "double", "Age": "double", "Sleep_Hours": "double",
                "Daily_Phone_Usage_Hours": "double", "Daily_Walking_Running_Hours": "double",
                "Daily_Coffee_Tea_Consumption": "double", "Focus_Score_Video": "double"}


def export_schema():
    from pyspark.sql import types as T
    m = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType()}
    return T.StructType([T.StructField(c, m[EXPORT_TYPES.get(c, "int")], True) for c in S.EXPORT_COLS])


def enriched_export(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Write the 27 export columns as header CSV, read them back with their schema."""
    path = path or shared_scratch(spark, "export")
    feat = features(patients_raw(spark, sf_dir))
    write_csv(feat.select(*S.EXPORT_COLS), path)
    return read_csv_as(spark, path, export_schema())


def csv_executive_summary(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """The questionnaire file path end to end: the cohort is written as a header CSV
    (the 32 file columns, no id), loaded by the fixed-schema reader, cleaned and
    summarised. The summary never reads the key, so none is made."""
    path = path or shared_scratch(spark, "csv")
    write_csv(patients_raw(spark, sf_dir).select(*S.CSV_SCHEMA.fieldNames()), path)
    return Q.executive_summary(clean(read_questionnaire_csv(spark, path, with_id=False)
                                     .withColumn("id", F.lit(None).cast("long"))))


def peek_rows(spark: SparkSession, sf_dir: str, n: int = 10) -> DataFrame:
    """First rows by key after load (the look the load script takes)."""
    return peek(patients_raw(spark, sf_dir), n, "id")


def id_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_check(patients_raw(spark, sf_dir), "id")


def cleaned_parquet_roundtrip(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Store the cleaned table once (Parquet, partitioned by life stage) and run the
    pediatric comorbidity query on it: the stage and age filters then prune partitions
    and push into the scan."""
    path = path or shared_scratch(spark, "clean")
    write_parquet(clean(patients_raw(spark, sf_dir)), path, partition_by=["Life_Stage"])
    stored = spark.read.parquet(path).where(F.col("Life_Stage") == "Pediatric (5-14)")
    return Q.comorbidity_matrix(stored)


def appended_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cohort stored in three loads under one surrogate key: per load its rows, distinct keys and
    key range."""
    table = AppendedTable(spark, shared_scratch(spark, "appended"))
    raw = patients_raw(spark, sf_dir).withColumnRenamed("id", "patient")
    for load in range(3):
        table.append(raw.where(F.col("patient") % 3 == load))
    return (table.read().groupBy(F.col("load").cast("int").alias("load"))
            .agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("distinct_keys"),
                 F.min("id").alias("first_key"), F.max("id").alias("last_key")).orderBy("load"))


def folded_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The executive summary kept by three loads, one of which came incomplete first."""
    store = SummaryStore(spark, shared_scratch(spark, "summary"))
    rows = clean(patients_raw(spark, sf_dir))
    for load in range(3):
        own = rows.where(F.col("id") % 3 == load)
        if load == 1:
            store.fold(f"load{load}", own.where(F.col("id") % 2 == 0))
        store.fold(f"load{load}", own)
    return store.summary()
