"""The same operators run directly on the driver's other tables, as a user would run
them on any table: shares and prevalence on ``lineitem``, box statistics on
``events``, prevalence of a label joined to ``documents``, exact percentiles and a
Kruskal-Wallis test on a continuous column with many distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strata.operators import charts as C
from strata.operators import metrics as M
from strata.operators import stats as ST
from strata.operators.selection import range_percentiles
from strata.sources.cohort import table


def lineitem_flag_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (return flag, line status): lines, discounted lines (> 5 %), their share,
    and the share of the flag's lines."""
    li = table(spark, sf_dir, "lineitem")
    out = M.prevalence(li, ["l_returnflag", "l_linestatus"], F.col("l_discount") > 0.05,
                       count_name="lines", pos_name="discounted", pct_name="discounted_pct")
    return M.share(out, "lines", within=["l_returnflag"], name="pct_of_flag").orderBy(
        "l_returnflag", "l_linestatus")


def lineitem_price_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quartiles and 90th percentile of a continuous column per group, by range refinement
    (no group's values are gathered on one task, no table of distinct values is written)."""
    li = table(spark, sf_dir, "lineitem")
    q = range_percentiles(li, "l_extendedprice", ["l_linestatus"], [0.25, 0.5, 0.75, 0.9])
    return q.select("l_linestatus", "n", *[F.round(F.col("q")[i], 6).alias(name) for i, name in
                                           enumerate(["p25", "p50", "p75", "p90"])]).orderBy("l_linestatus")


def lineitem_kruskal(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return ST.kruskal_wallis(li, ["l_extendedprice", "l_quantity", "l_discount"], "l_returnflag")


def events_value_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return C.box_stats(ev, ["value"], "event_type", digits=6, method="range")


def toxic_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents per language and the share flagged toxic; only the key and
    language columns of ``documents`` are read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    joined = docs.join(labels, "doc_id")
    return M.prevalence(joined, ["lang"], F.col("toxic") == 1, count_name="labelled",
                        pos_name="toxic", pct_name="toxic_pct").orderBy("lang")
