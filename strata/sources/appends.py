"""A stored table whose surrogate key survives appends, and a summary kept up to date with its loads.

Every load is a folder of its own. Its keys are a range reserved after the highest key of the
loads before, so earlier rows keep theirs, like a database's serial column.

The summary keeps one partial state per load and life stage (counts and sums, which add up). A
load that comes again replaces its state, which takes its old rows out of the summary; no other
load is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strata.functions import labels as L
from strata.functions.scores import flag, pct
from strata.sources import schema as S
from strata.sources.cohort import with_surrogate_id


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class AppendedTable:
    """Parquet under ``path``: rows in ``rows/load=<n>``, key ranges in ``loads``."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def loads(self) -> DataFrame | None:
        """(load, rows, first_key, last_key) of the complete loads; a load without its range does not count."""
        return self.spark.read.parquet(f"{self.path}/loads") if _exists(self.spark, f"{self.path}/loads") else None

    def append(self, rows: DataFrame) -> int:
        """Stores ``rows`` (without the key) as the next load and returns its number.

        Keys are dense, in the order of a hash of the cells, from the high-water mark on. The rows are
        written first and the range last: a load that fails in between is written over by the next
        one. One writer at a time; a table read by others is always complete."""
        known = self.loads()
        load, high = known.agg(F.max("load"), F.max("last_key")).first() if known is not None else (0, 0)
        load += 1
        target = f"{self.path}/rows/load={load}"
        keyed = with_surrogate_id(rows, self.key).withColumn(self.key, F.col(self.key) + F.lit(high).cast("long"))
        keyed.write.mode("overwrite").parquet(target)
        n = self.spark.read.parquet(target).count()
        mark = self.spark.createDataFrame([(load, n, high + 1, high + n)], "load int, rows long, first_key long, last_key long")
        mark.coalesce(1).write.mode("append").parquet(f"{self.path}/loads")
        return load

    def read(self) -> DataFrame:
        """All rows of the complete loads with their key and ``load``."""
        done = [r["load"] for r in self.loads().select("load").collect()]  # one number per load
        rows = self.spark.read.option("basePath", f"{self.path}/rows").parquet(*[f"{self.path}/rows/load={n}" for n in sorted(done)])
        return rows


# The means of the summary by output name.
MEANS = {"avg_severity": "Total_Severity", "avg_sleep": "Sleep_Hours", "avg_screen_time": "Daily_Phone_Usage_Hours",
         "avg_anxiety": "Anxiety_Depression_Levels"}
COUNTS = ("total_patients", "adhd_total", "inattentive_count", "hyperactive_count", "combined_count", "family_history_yes")


def summary_states(clean: DataFrame) -> DataFrame:
    """Per life stage the sums that the summary is made of."""
    dx = F.col("Diagnosis_Class")
    whole = [F.lit(1), flag(dx != 0), flag(dx == 1), flag(dx == 2), flag(dx == 3), flag(F.col("Family_History") == "Yes")]
    sums = [F.sum(c).cast("long").alias(n) for n, c in zip(COUNTS, whole)]
    for name, c in MEANS.items():
        sums += [F.sum(F.col(c).cast("double")).alias(f"{name}_sum"), F.count(c).alias(f"{name}_n")]
    return clean.where(F.col("Life_Stage").isNotNull()).groupBy("Life_Stage").agg(*sums)


def summary_of_states(states: DataFrame) -> DataFrame:
    """The executive summary from any number of partial states."""
    sums = [F.sum(c).alias(c) for c in COUNTS] + [F.sum(f"{n}_{s}").alias(f"{n}_{s}") for n in MEANS for s in ("sum", "n")]
    total = states.groupBy("Life_Stage").agg(*sums)
    means = [F.round(F.col(f"{n}_sum") / F.nullif(F.col(f"{n}_n"), F.lit(0)), 1).alias(n) for n in MEANS]
    order = L.order_key("Life_Stage", [s[2] for s in S.LIFE_STAGES])
    return (total.where("total_patients > 0").orderBy(F.asc_nulls_last(order)).select(
        "Life_Stage", "total_patients", pct("adhd_total", "total_patients").alias("adhd_prevalence_pct"),
        "inattentive_count", "hyperactive_count", "combined_count", *means,
        pct("family_history_yes", "total_patients").alias("family_history_pct")))


class SummaryStore:
    """Partial states of the summary under ``path``, one version per load and time it was folded in."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _states(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/states") if _exists(self.spark, f"{self.path}/states") else None

    def fold(self, load: str, clean: DataFrame) -> None:
        """Adds a load's rows to the summary, in place of those it had before under this name. Only
        ``clean`` is read. A version counts when its files are committed, all at once."""
        known = self._states()
        last = known.where(F.col("load") == load).agg(F.max("version")).first()[0] if known is not None else None
        states = summary_states(clean)
        # a load without rows still has a version, which retracts the one before
        none = self.spark.range(1).select(*[F.lit(None).cast(t).alias(c) for c, t in states.dtypes])
        out = states.unionByName(none).withColumn("load", F.lit(load)).withColumn("version", F.lit((last or 0) + 1))
        out.coalesce(1).write.mode("append").parquet(f"{self.path}/states")  # one row per stage

    def summary(self) -> DataFrame:
        """The summary of all loads as they are now; a few rows per load are read."""
        states = self._states()
        now = states.groupBy("load").agg(F.max("version").alias("version"))
        return summary_of_states(states.join(now, ["load", "version"]).where(F.col("Life_Stage").isNotNull()))
