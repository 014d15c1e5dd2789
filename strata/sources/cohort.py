"""Readers: the questionnaire CSV, stored Parquet tables, and the stand-in cohort.

No patient file ships with the test data, so the stand-in cohort derives one patient
row per order from the driver's ``orders`` table (see FIXTURES.md §2). It is a pure
projection: one narrow, pipelined stage, no shuffle, work proportional to ``orders``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from strata.operators.windows import bucket_target, exact_row_number, hash_prefix_for
from strata.sources import schema as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# The texts that the notebook's CSV reader takes as missing.
MISSING_MARKERS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                   "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# the file's columns, all as text: cells are typed by ``typed_cells``
TEXT_SCHEMA = T.StructType([T.StructField(f.name, T.StringType(), True) for f in S.CSV_SCHEMA.fields])


# Quotes inside a quoted cell are doubled and a backslash is a letter like any other.
CSV_QUOTING = {"quote": '"', "escape": '"'}


def read_questionnaire_csv(spark: SparkSession, path: str, with_id: bool = True, rules: str = "notebook",
                           multi_line: bool = False) -> DataFrame:
    """Header CSV with the fixed 32-column schema; header names are checked, not inferred.

    A quoted cell may hold commas and doubled quotes. ``multi_line`` lets it hold line breaks too;
    a file is then read by one task, so many files are better than a large one.

    Cells are read as text under the fixed header, then typed by :func:`typed_cells`; a value that
    is neither a number nor a marker fails the load instead of silently turning NULL.
    ``with_id`` adds the surrogate key of :func:`with_surrogate_id`."""
    df = (spark.read.schema(TEXT_SCHEMA).option("header", True).option("enforceSchema", False)
          .option("mode", "FAILFAST").option("nullValue", "").option("ignoreLeadingWhiteSpace", False)
          .option("ignoreTrailingWhiteSpace", False).option("multiLine", multi_line).options(**CSV_QUOTING).csv(path))
    if with_id:
        df = with_surrogate_id(df)
    return df.select(*(["id"] if with_id else []), *typed_cells(rules))


def with_surrogate_id(df: DataFrame, name: str = "id") -> DataFrame:
    """A dense key 1..n in the order of a hash of the cells (equal rows in any order: they are
    interchangeable). It is unique and does not depend on files, splits or partitions. The rows
    are numbered in two levels over hash ranges, one shuffle, no single task."""
    order = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    digits = hash_prefix_for(bucket_target(df.sparkSession))
    out = exact_row_number(df.withColumn("_order", order), [], [F.asc("_order")], [F.substring("_order", 1, digits)], name=name)
    return out.select(F.col(name).cast("bigint").alias(name), *[F.col(f"`{c}`") for c in df.columns])


def typed_cells(rules: str = "notebook") -> list[Column]:
    """The 32 file columns typed from text.

    ``notebook``: a cell that is one of ``MISSING_MARKERS`` is NULL, in text columns too.
    ``sql``: only the blank cell is NULL; ``NA`` is text in a text column and an error in a
    numeric one. In both, numeric cells are trimmed and text cells are kept as they are; NaN
    never enters (it would pass ``NaN > 4`` in Spark); an integer column takes ``2.0`` as 2 (what
    a column with gaps is written as) and fails on a fraction."""
    if rules not in ("notebook", "sql"):
        raise ValueError("rules: notebook or sql")
    markers = MISSING_MARKERS if rules == "notebook" else ("",)
    cols = []
    for f in S.CSV_SCHEMA.fields:
        raw = F.col(f.name)
        if f.dataType == T.StringType():
            out = F.when(raw.isNull() | raw.isin(*markers), F.lit(None)).otherwise(raw)
        else:
            cell = F.trim(raw)
            number = cell.cast("double")  # an ANSI cast: anything but a number fails
            if f.dataType != T.DoubleType():
                whole = F.when(number == F.floor(number), number)
                number = F.when(whole.isNull(), F.raise_error(F.concat(F.lit(f"not a whole number in {f.name}: "), cell))
                                .cast("double")).otherwise(whole)
            number = F.nullif(number, F.lit(float("nan")))
            out = F.when(cell.isNull() | cell.isin(*markers), F.lit(None)).otherwise(number).cast(f.dataType)
        cols.append(out.cast(f.dataType).alias(f.name))
    return cols


def _edge(cond: Column, value, expr: Column) -> Column:
    return F.when(cond, value).otherwise(expr)


def cohort_from_orders(orders: DataFrame, edge: bool = False) -> DataFrame:
    """Stand-in patient table (33 columns) derived row by row from ``orders``.

    ``edge=True`` plants the edge rows of FIXTURES.md: fractional ages and ages beyond the bands,
    missing sleep, a missing questionnaire item, missing and unknown diagnosis and gender codes, a
    missing family history, and a family history level that occurs with one diagnosis only.
    """
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    p = F.floor(F.col("o_totalprice")).cast("bigint")
    dbl, i32 = "double", "int"

    age = (F.lit(3) + p % 53).cast(dbl)
    sleep = (F.lit(4) + (p % 13) * 0.5).cast(dbl)
    q1 = [((p + k * j) % 4).cast(i32).alias(f"Q1_{j}") for j in range(1, 10)]
    q2 = [((p * j + c) % 4).cast(i32).alias(f"Q2_{j}") for j in range(1, 10)]
    dx = ((k + p) % 4).cast(i32)
    if edge:
        age = _edge(k % 83 == 0, F.lit(4.5), age)
        sleep = _edge(k % 97 == 0, F.lit(None).cast(dbl), sleep)
        q1[2] = _edge(k % 89 == 0, F.lit(None).cast(i32), ((p + k * 3) % 4).cast(i32)).alias("Q1_3")
        dx = _edge(k % 101 == 0, F.lit(None).cast(i32), dx)
        dx = _edge(k % 109 == 0, F.lit(9), dx)
        age = _edge(k % 113 == 0, F.lit(56.0), age)

    gender = (F.lit(1) + c % 2).cast(i32)
    fam = F.when(p % 3 == 0, "Yes").when(p % 3 == 1, "No").otherwise("Unknown")
    if edge:
        gender = _edge(k % 103 == 0, F.lit(None).cast(i32), _edge(k % 107 == 0, F.lit(9), gender))
        # a level that never meets three of the classes: empty cells in every cross-tab
        fam = _edge((k % 31 == 0) & (dx == 1), "Adopted", fam)
        fam = _edge(k % 127 == 0, F.lit(None).cast("string"), fam)
    return orders.select(
        k.alias("id"),
        age.alias("Age"),
        gender.alias("Gender"),
        F.col("o_orderpriority").alias("Educational_Level"),
        fam.alias("Family_History"),
        sleep.alias("Sleep_Hours"),
        ((k % 9) * 0.5).cast(dbl).alias("Daily_Activity_Hours"),
        *q1, *q2,
        dx.alias("Diagnosis_Class"),
        ((c % 17) * 0.5).cast(dbl).alias("Daily_Phone_Usage_Hours"),
        ((k % 7) * 0.5).cast(dbl).alias("Daily_Walking_Running_Hours"),
        (p % 2).cast(i32).alias("Difficulty_Organizing_Tasks"),
        ((p % 21) * 0.5).cast(dbl).alias("Focus_Score_Video"),
        (k % 6).cast(dbl).alias("Daily_Coffee_Tea_Consumption"),
        ((c + k) % 2).cast(i32).alias("Learning_Difficulties"),
        (p % 5).cast(i32).alias("Anxiety_Depression_Levels"),
    )


def patients_raw(spark: SparkSession, sf_dir: str, edge: bool = False) -> DataFrame:
    return cohort_from_orders(table(spark, sf_dir, "orders"), edge=edge)


def peek(df: DataFrame, n: int = 10, order_by: str | None = "id") -> DataFrame:
    """First rows for a look after load (a limit is the feature here). Ordered by the
    key, the rows are the same every time; each task keeps only its first ``n``."""
    return (df.orderBy(order_by) if order_by else df).limit(n)
