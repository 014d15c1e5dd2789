"""Joining rows to small derived tables (group statistics, histograms, offsets).

The small side is always an aggregate of the big one. It is written once as Parquet under the
cluster's shared ``spark.checkpoint.dir`` (this also cuts its lineage, so a lost executor does
not re-run the aggregate), which gives the planner its true size in bytes:
``spark.sql.autoBroadcastJoinThreshold`` then decides between a broadcast and a shuffled join
with AQE skew-join splitting, so a hot key is split across tasks instead of landing whole on one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F


PROVEN_BROADCAST_ROWS = 100_000  # a caller's bound up to here is broadcast without a look at the size


def materialize(df: DataFrame, name: str = "mat") -> DataFrame:
    """Write ``df`` once as Parquet into a fresh folder under the session's shared
    checkpoint folder and read it back.

    This cuts the lineage like a reliable checkpoint (a lost executor re-reads the files
    instead of recomputing the input) but computes ``df`` exactly once (an eager RDD
    checkpoint of an unpersisted plan computes it twice), stores it columnar, and gives
    the planner the true size of the result."""
    from strata.sources.sinks import shared_scratch
    spark = df.sparkSession
    path = shared_scratch(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query go when it ends and not when the driver happens to collect
    garbage: many large shuffles one after the other take the disk of one."""
    before = spark.conf.get(FILE_CLEANUP) if spark.conf.isModifiable(FILE_CLEANUP) else None
    if before is not None:
        spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(FILE_CLEANUP, before)


def join_small(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner",
               null_safe: bool = False, proven_rows: int | None = None) -> DataFrame:
    """Join ``big`` to an aggregated ``small`` on the columns ``on``.

    ``proven_rows``: the caller's proof that ``small`` has at most that many rows (e.g.
    grouped by a label made from a fixed code list); it is then broadcast directly.
    Otherwise the planner decides by the written size. ``null_safe`` matches NULL keys to
    NULL keys (``<=>``); the key columns of ``small`` are then dropped from the result.
    """
    if proven_rows is not None and proven_rows <= PROVEN_BROADCAST_ROWS:
        right = F.broadcast(small)
    else:
        right = materialize(small)
    if not null_safe:
        return big.join(right, list(on), how)
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in small.columns])
    cond = reduce(lambda a, b: a & b, [big[c].eqNullSafe(renamed[f"__r_{c}"]) for c in on])
    return big.join(renamed, cond, how).drop(*[f"__r_{c}" for c in on])
