"""The registered queries, the entry's guard and the pipeline."""

import os
import subprocess
import sys

import duckdb
import pytest

import corpus_pipeline
from strata.llm import decontam, jaccard, registry
from strata.llm.registry import table

from .helpers import LABELS

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def rows(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = registry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert rows(got, columns) == sorted(map(tuple, want.fetchall()), key=repr)


def test_one_query_per_operator():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]


def test_pipeline_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "mixing":
            assert after.columns == docs.columns
        kept[name] = (docs, after)
        docs = after
    text = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    before, after = map(text, kept["near_copies"])
    comp = jaccard.brute_force(before, 5, 80)
    assert set(after) == {i for i, (_, c) in comp.items() if i == c}
    before, after = map(text, kept["decontamination"])
    items = [(str(r.item_id), r.text) for r in table(spark, SF, "benchmark").collect()]
    hits = decontam.brute_force(list(before.values()), items, 10)
    assert set(after) == {i for i, (_, n, _) in zip(before, hits) if not n}
    before, after = map(text, kept["secrets"])
    assert set(before) == set(after)
    before, after = kept["mixing"]
    assert set(after.columns) == set(before.columns) | {"mix_size", "mix_target", "mix_taken"}
    assert after.count() > 0 and after.where("mix_taken <= 0 or mix_taken > 2 * mix_size").count() == 0


def write_tables(spark, base, docs, labels, benchmark):
    docs.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def test_pipeline_on_edge_rows(spark, edge_docs, edge_rows, tmp_path):
    labels = [(i, 1, 0) for i in range(12)] + [(None, 0, 1), (3, None, None)]
    base = write_tables(spark, str(tmp_path), edge_docs, labels, [(1, "two words"), (None, None)])
    out = corpus_pipeline.run(spark, base)
    assert out.columns == edge_docs.columns + ["mix_size", "mix_target", "mix_taken"]
    texts = [r.text for r in out.collect()]
    assert "Two words" not in texts and "one" in texts and "a b c d" in texts
    assert len(texts) == len(set(texts)) and all(t and t.strip() for t in texts)


def test_pipeline_on_empty_tables(spark, no_docs, edge_docs, tmp_path):
    assert corpus_pipeline.run(spark, write_tables(spark, f"{tmp_path}/a", no_docs, [(1, 1, 1)], [(1, "a b")])).collect() == []
    assert corpus_pipeline.run(spark, write_tables(spark, f"{tmp_path}/b", edge_docs, [], [])).count() > 0


def test_run_equals_the_stages(spark):
    a = rows(corpus_pipeline.run(spark, SF), ["doc_id", "mix_taken"])
    assert a == rows(corpus_pipeline.run(spark, SF), ["doc_id", "mix_taken"]) and a


def test_nothing_else_imports_the_subpackage():
    out = subprocess.run(["grep", "-rln", "--include=*.py", "strata.llm\\|corpus_pipeline", "strata", "tools", "bench.py", "tests"],
                         cwd=ROOT, capture_output=True, text=True).stdout.split()
    assert all(f.startswith(("strata/llm/", "tests/llm/")) for f in out), out


def test_entry_works_without_the_subpackage(tmp_path):
    for name in os.listdir(ROOT):
        if name not in (".git", "corpus_pipeline.py", "strata"):
            os.symlink(f"{ROOT}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "strata")
    for name in os.listdir(f"{ROOT}/strata"):
        if name != "llm":
            os.symlink(f"{ROOT}/strata/{name}", tmp_path / "strata" / name)
    os.unlink(tmp_path / "__spark_entry__.py")
    with open(f"{ROOT}/__spark_entry__.py") as f:
        (tmp_path / "__spark_entry__.py").write_text(f.read())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})
