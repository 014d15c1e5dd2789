"""Execute every registered query (models excepted) and tabulate its final adaptive
plan: shuffles by kind, joins by strategy, windows, sorts and the widest scan.
Writes PLANS.md. Usage: python tools/plan_report.py [sf_dir]"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from strata.operators import joins  # noqa: E402
from strata.plans import registry  # noqa: E402
from strata.session import local_session  # noqa: E402

MODELS = {"rf_report", "rf_confusion", "rf_importance", "cv_accuracy", "model_comparison", "key_findings",
          "forest_nodes", "forest_predictions", "forest_importance", "cv_accuracy_shallow", "boosting_nodes",
          "boosting_predictions", "logistic_gradient", "logistic_two_classes"}


def executed(df) -> str:
    """Run the frame's own plan (not a copy of it) and return it as it ended."""
    qe = df._jdf.queryExecution()
    qe.toRdd().count()
    return final_only(qe.executedPlan().toString())


def final_only(text: str) -> str:
    """The text without any "Initial Plan" part: each ends where its subtree's indent ends."""
    out, skip = [], None
    for line in text.split("\n"):
        indent = len(line) - len(line.lstrip(" :+-|"))
        if skip is not None and indent <= skip and line.strip():
            skip = None
        if "== Initial Plan ==" in line:
            skip = len(line) - len(line.lstrip(" :+-|")) - 1
        if skip is None:
            out.append(line)
    return "\n".join(out)


class Steps:
    """Collects the plans of the tables written while a query is built."""

    def __init__(self):
        self.plans = []

    def materialize(self, df, name="mat"):
        self.plans.append(executed(df))
        return self.real(df, name)

    def __enter__(self):
        self.real = joins.materialize
        self.places = [m for m in list(sys.modules.values()) if getattr(m, "materialize", None) is self.real]
        for m in self.places:
            m.materialize = self.materialize
        return self

    def __exit__(self, *_):
        for m in self.places:
            m.materialize = self.real


def summarize(plan: str) -> dict:
    final = plan
    ex = re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobinPartitioning)", final)
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", final)
    return {
        "hash": ex.count("hashpartitioning"), "range": ex.count("rangepartitioning"),
        "single": ex.count("SinglePartition"),
        "bcast": len(re.findall(r"BroadcastExchange", final)),
        "bhj": len(re.findall(r"BroadcastHashJoin", final)),
        "shj": len(re.findall(r"ShuffledHashJoin", final)),
        "smj": len(re.findall(r"SortMergeJoin", final)),
        "window": len(re.findall(r"\bWindow\b", final)),
        "subq": len(re.findall(r"Subquery subquery", final)),
        "scan_cols": max((len(s.split(",")) for s in scans), default=0),
        "cross": "CartesianProduct" in final or "NestedLoopJoin" in final,
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    rows = []
    for name, fn in registry.queries().items():
        if name in MODELS or name.endswith("_edge"):
            continue
        with Steps() as steps:
            main_plan = executed(fn(spark, sf_dir))
        both = summarize("\n".join([main_plan, *steps.plans]))
        rows.append((name, both | {"steps": len(steps.plans)}))
    head = ("| query | hash shuffles | range shuffles | single-partition | broadcasts | BHJ | SHJ | SMJ "
            "| windows | subqueries | widest scan (cols) | written steps |\n| --- | --- | --- | --- | --- | --- | --- | --- "
            "| --- | --- | --- | --- |")
    lines = [f"| {n} | {s['hash']} | {s['range']} | {s['single']} | {s['bcast']} | {s['bhj']} | {s['shj']} "
             f"| {s['smj']} | {s['window']} | {s['subq']} | {s['scan_cols']} | {s['steps']} |" for n, s in rows]
    crosses = [n for n, s in rows if s["cross"]]
    text = f"""# PLANS — final adaptive plans of the registered queries

Generated by `python tools/plan_report.py {sf_dir}` on local[8] (8 shuffle partitions).
Counts are operators in the final (AQE) plans that ran: the query's own plan with its scalar
subqueries, and the plans of the tables it writes while it is built ("written steps").
"single-partition" exchanges feed windows or sorts over already aggregated rows (shares, ranks
of groups, rolling means). "widest scan" is the number of columns the widest Parquet scan
reads. Model fits are not listed (they are Spark ML jobs).

Cross products or nested-loop joins: {', '.join(crosses) if crosses else 'none'}.

How to read it against scale:

- a grouped query is one hash shuffle of partial aggregates;
- `severity_quartile`, `split_*` and `fold_*` count rows per (group, coarse order) and number the
  rows of the few cells that hold a cut; the rows themselves are labelled in the scan;
- joins of rows to per-group tables are broadcast hash joins (BHJ), on a proven bound or because
  the written table is below `spark.sql.autoBroadcastJoinThreshold`.

{head}
""" + "\n".join(lines) + "\n"
    out = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(out, "w") as fh:
        fh.write(text)
    print(f"wrote {out} ({len(rows)} queries); cross products: {crosses or 'none'}")
    spark.stop()


if __name__ == "__main__":
    main()
