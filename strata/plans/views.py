"""Temp views for users who work in SQL: the raw cohort, the cleaned view, the feature
table and the executive summary, registered on a session so that analytic SQL runs on
Spark SQL (and through Catalyst) unchanged in spirit.

Two habits of other dialects need care in Spark SQL (SURVEY §0): ``NUMERIC`` without
precision is ``DECIMAL(10,0)`` here (drop such casts; measures are already DOUBLE), and
a window over an aggregate cannot sit next to an ``ORDER BY`` on an unselected
aggregate (aggregate in a subquery first).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.operators.clean import clean, features
from strata.plans.queries import executive_summary
from strata.sources.cohort import patients_raw

VIEW_NAMES = ("patients_raw", "patients_clean", "patients_features", "patients_summary")


def register_views(spark: SparkSession, sf_dir: str | None = None, raw: DataFrame | None = None,
                   edge: bool = False) -> dict[str, DataFrame]:
    """Create or replace the four temp views; ``raw`` defaults to the stand-in cohort of
    ``sf_dir``. Returns the DataFrames by view name."""
    if raw is None:
        if sf_dir is None:
            raise ValueError("give sf_dir or raw")
        raw = patients_raw(spark, sf_dir, edge=edge)
    cleaned = clean(raw)
    frames = dict(zip(VIEW_NAMES, (raw, cleaned, features(raw), executive_summary(cleaned))))
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return frames
