"""strata: cohort and questionnaire analytics as lazy Spark DataFrame operators.

Layout
------
sources/    schemas, fixed code lists, readers (CSV, Parquet, the stand-in cohort), sinks
functions/  column expressions: labels, bands, flags, scores, p-value helpers
operators/  DataFrame -> DataFrame building blocks: clean, features, metrics,
            windows at scale, statistical tests, chart datasets, models
plans/      the query set (one function per analytic query) and its SQL oracle
streaming/  the same loader and summary over files that keep arriving
"""

from strata.session import local_session, ensure_checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
