import zlib
from collections import Counter, defaultdict

import pytest

from strata.llm.sharding import assign_shards, shard_report, write_shards

from .helpers import doc, frame


def shards_of(df):
    return {r.doc_id: r.shard for r in df.select("doc_id", "shard").collect()}


@pytest.fixture(scope="module")
def many(spark):
    return frame(spark, [doc(i, f"text {i % 50}") for i in range(4000)])


def test_new_shard_takes_only_into_itself(many):
    before, after = shards_of(assign_shards(many, 8)), shards_of(assign_shards(many, 9))
    moved = {i for i in before if before[i] != after[i]}
    assert moved and all(after[i] == 8 for i in moved)
    assert len(moved) == pytest.approx(4000 / 9, rel=0.2)


def test_weights_are_shares_and_raising_one_only_draws_in(many):
    before, after = shards_of(assign_shards(many, [1, 2, 5])), shards_of(assign_shards(many, [1, 4, 5]))
    n = Counter(before.values())
    assert [n[s] / 4000 for s in range(3)] == pytest.approx([1 / 8, 2 / 8, 5 / 8], abs=0.04)
    assert all(after[i] == 1 for i in before if before[i] != after[i])


def test_weights_must_be_positive(many):
    for bad in ([], [1, 0], 0):
        with pytest.raises(ValueError):
            assign_shards(many, bad)


def test_report_on_edge_rows(edge_docs, edge_rows):
    rows = shard_report(edge_docs, 5).collect()
    assert len(rows) == len(edge_rows)
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in edge_rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 5)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len({r.shard for r in rows if r.doc_id == i}) == 1 for i in {r.doc_id for r in rows})


def test_one_key_with_most_rows_and_any_partitioning(spark):
    rows = [doc(None if i % 3 else i, "same" if i % 2 else f"t{i}") for i in range(3000)]
    got = [sorted(map(tuple, shard_report(d, 7).collect()), key=repr)
           for d in (frame(spark, rows).repartition(13), frame(spark, rows[::-1]).coalesce(1))]
    assert got[0] == got[1] and len(got[0]) == 3000


def test_empty_table(no_docs):
    assert shard_report(no_docs).collect() == [] and assign_shards(no_docs, 3).collect() == []


def test_written_shards_hold_every_row(spark, edge_docs, tmp_path):
    path = f"{tmp_path}/shards"
    write_shards(edge_docs, path, [1, 1, 3])
    back = spark.read.parquet(path)
    assert back.count() == edge_docs.count() and set(back.columns) == set(edge_docs.columns) | {"shard"}
    want = assign_shards(edge_docs, [1, 1, 3])
    key = lambda df: Counter((r.doc_id, r.text, r.shard) for r in df.collect())
    assert key(back) == key(want)
