import hashlib
import random

import numpy as np
import pytest

from strata.llm import decontam as D

from .helpers import doc, frame

VOCAB = [*"abcdefg", "é1", "Ü2", "9x"]


def text(rng, n):
    return "".join(rng.choice(VOCAB) + rng.choice([" ", "  ", "-", "\n", ". "]) for _ in range(n))


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "item_id long, text string, spans string, n_words int")


def report(df, bench, width):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
            for r in D.contamination_report(df, bench, width).collect()}


def expected(n_words, n_hit, found):
    return n_words, n_hit, len(found.split(",")) if found else 0, hashlib.sha256(found.encode()).hexdigest(), n_hit > 0


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    bench = [(i, text(rng, n)) for i, n in enumerate([0, 1, 2, 3, 9, 12, 15])] + [(5, text(rng, 6)), (70, None)]
    texts = [text(rng, rng.choice([0, 1, 5, 60, 300])) for _ in range(40)] + [None, "", "ab" * 5000]
    got = report(frame(spark, [doc(i, t) for i, t in enumerate(texts)]), items(spark, bench), 4)
    want = D.brute_force(texts, [(str(i), t) for i, t in bench], 4)
    assert got == {i: expected(*w) for i, w in enumerate(want)}


def test_blocks_of_the_benchmark_unite(spark, monkeypatch):
    rng = random.Random(8)
    bench = [(i, text(rng, 8)) for i in range(30)]
    texts = [text(rng, 200) for _ in range(20)]
    df, b = frame(spark, [doc(i, t) for i, t in enumerate(texts)]), items(spark, bench)
    one = sorted(map(repr, D.find_contamination(df, b, 3).collect()))
    monkeypatch.setattr(D, "SHARD_BYTES", 1500)
    many = D.find_contamination(df, b, 3, block_bytes=20)
    assert sorted(map(repr, many.collect())) == one
    # one scan, whatever the number of blocks
    assert many._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert len(D.benchmark_files(b, 3, 20)) > 20
    clean = {r.doc_id for r in D.drop_contaminated(df, b, 3, block_bytes=20).collect()}
    assert clean == {r.doc_id for r in D.find_contamination(df, b, 3).collect() if not r["items"]}


def test_shards_hold_every_row():
    import pyarrow as pa
    texts = [None, "", "a" * 4000, "b" * 100, None] * 7
    batch = pa.RecordBatch.from_arrays([pa.array(range(35)), pa.array(texts)], names=["k", "text"])
    for size in (1, 150, 5000, 10 ** 9):
        D_size, D.SHARD_BYTES = D.SHARD_BYTES, size
        try:
            got = [k for s in D._shards([batch], "text") for k in s.column(0).to_pylist()]
        finally:
            D.SHARD_BYTES = D_size
        assert got == list(range(35))


def test_fm_index():
    rng = np.random.default_rng(4)
    for n, size in ((1, 1), (7, 2), (300, 3), (500, 40)):
        t = rng.integers(0, size + 1, n)
        index = D.FMIndex(t, size + 1)
        patterns = rng.integers(0, size + 1, (50, 3))
        which, low, high = index.search(patterns)
        found = {int(w): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, low, high)}
        for k, p in enumerate(patterns):
            want = [i for i in range(n - 2) if (t[i:i + 3] == p).all()]
            assert found.get(k, []) == want


def test_edges(spark, edge_docs, edge_rows, no_docs):
    bench = items(spark, [(1, "w1 Déjà x1 w2 Déjà"), (None, "two words"), (3, None)])
    rows = D.contamination_report(edge_docs, bench, 10).collect()
    assert len(rows) == len(edge_rows)
    got = {r.doc_id: r for r in rows}
    assert got[5].n_hit == 2 and got[5].n_items == 1 and got[5].items_sha256 == D.sha("")
    assert got[8].contaminated and not got[0].contaminated and got[0].n_words == 0
    assert D.contamination_report(no_docs, bench, 10).collect() == []
    none = D.contamination_report(edge_docs, items(spark, []), 10).collect()
    assert not any(r.contaminated for r in none)
    kept = D.drop_contaminated(edge_docs, bench)
    assert kept.columns == edge_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(
        (r.doc_id for r in rows if not r.contaminated), key=repr)
