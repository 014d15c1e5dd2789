"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strata.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``links`` (a, b) -> (id, component): the smallest id reachable. Only ids with links appear.

    Every round takes the smallest label among the neighbours and then the label's own label, so
    long chains shrink by doubling. Each round is a written table; nothing is collected but the
    number of changes. An id with very many links only meets partial aggregates and joins that
    adaptive execution splits."""
    both = scratch.save(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), f"{name}_edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("a"), F.min("b")).alias("component")),
                          f"{name}_0")
    round_ = 0
    while True:
        round_ += 1
        near = (both.join(labels.select(F.col("id").alias("b"), "component"), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near")))
        step = (labels.join(near, "id")
                .select("id", F.col("component").alias("old"), F.least("component", "near").alias("mid")))
        jump = labels.select(F.col("id").alias("mid"), F.col("component").alias("far"))
        step = step.join(jump, "mid", "left").select(
            "id", "old", F.least("mid", F.coalesce("far", "mid")).alias("component"))
        saved = scratch.save(step, f"{name}_{round_}")
        changed = saved.where("old <> component").limit(1).count()
        labels = saved.select("id", "component")
        if not changed:
            return labels
