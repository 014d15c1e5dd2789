"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print
one JSON line with the per-query wall time (seconds, best of $BENCH_REPEAT runs).

Each run builds the query and executes its whole plan into Spark's ``noop`` sink, so
the time is the engine's (scan, shuffles, aggregates, writes of round-trip queries),
not the transfer of result rows into Python. Row counts come from one extra count.

Model fits are left out of the headline total (their cost is set by the analysed
workload's tree counts, not by the engine); set BENCH_MODELS=1 to time them too.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from strata.plans.registry import queries  # noqa: E402
from strata.session import local_session  # noqa: E402

MODEL_KEYS = {"rf_report", "rf_confusion", "rf_importance", "cv_accuracy", "model_comparison", "key_findings",
              "forest_nodes", "forest_predictions", "forest_importance", "cv_accuracy_shallow", "boosting_nodes",
              "boosting_predictions", "logistic_gradient", "logistic_two_classes"}


def headline(names):
    return [n for n in names if n not in MODEL_KEYS and not n.endswith("_edge")]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    with_models = os.environ.get("BENCH_MODELS", "0") == "1"
    spark = local_session(cores=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)))
    qs = queries()
    names = headline(qs) + (sorted(MODEL_KEYS) if with_models else [])
    # warm the JVM and the Python workers once
    qs["cohort_overview"](spark, sf_dir).collect()
    times, rows = {}, {}
    for name in names:
        best = None
        for _ in range(repeat if name not in MODEL_KEYS else 1):
            t0 = time.perf_counter()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            best = dt if best is None else min(best, dt)
        times[name] = round(best, 3)
        rows[name] = qs[name](spark, sf_dir).count()
    total = round(sum(v for k, v in times.items() if k not in MODEL_KEYS), 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "headline_query_seconds_total", "value": total, "unit": "sec",
                      "queries": times, "rows": rows, "sf": sf, "cpus": cpus, "repeat": repeat}))
    spark.stop()


if __name__ == "__main__":
    main()
