"""Plan-shape guards: no registered query plans a cross product or a nested-loop join,
and the two-level window shuffles its rows once."""

import pytest

from strata.plans import registry as E

SF = "/root/testdata/sf0.001"
MODELS = {"rf_report", "rf_confusion", "rf_importance", "cv_accuracy", "model_comparison", "key_findings"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(k for k in E.queries() if k not in MODELS and not k.endswith("_edge")))
def test_no_cross_product(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_two_level_window_shuffles_rows_once(spark):
    from pyspark.sql import functions as F
    from strata.operators.windows import exact_row_number
    df = spark.range(0, 5000).withColumn("g", F.col("id") % 3)
    out = exact_row_number(df, ["g"], [F.asc("id")], [F.floor(F.col("id") / 100)], name="rn")
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    # the rows' exchange feeds the join, whose output partitioning serves the window:
    # the window's input is not re-exchanged after the join
    after_join = plan.split("ShuffledHashJoin")[0]
    assert "Exchange" not in after_join.split("Window")[-1]
