"""Writing results out and reading them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from strata.session import ensure_checkpoint_dir


def shared_scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder (never a
    machine-local temp folder: on a cluster every executor must see it)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/strata-{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder of :func:`shared_scratch` that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Header CSV, one file per task (no coalesce to one writer). Quotes inside a cell are doubled;
    white space around text is kept."""
    (df.write.mode(mode).option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def read_csv_as(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """Read a header CSV written by :func:`write_csv` with an explicit schema; header
    names are checked against it. ``multi_line`` lets quoted cells hold line breaks."""
    return (spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("escape", '"')
            .option("multiLine", multi_line).option("mode", "FAILFAST").csv(path))


def key_check(df: DataFrame, key: str = "id") -> DataFrame:
    """Rows, distinct keys and keys seen more than once (a uniqueness rule)."""
    dup = df.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    return dup.agg(F.sum("c").cast("bigint").alias("rows"), F.count(F.lit(1)).alias("distinct_keys"),
                   F.count(F.when(F.col("c") > 1, F.lit(1))).alias("duplicate_keys"))
