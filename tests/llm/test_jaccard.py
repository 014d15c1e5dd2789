import random

import numpy as np
import pytest

from strata.llm import jaccard as J

from .helpers import doc, frame


def answer(df, **args):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_components(df, **args).collect()), key=repr)


def near_copies(rng):
    """Chains of edits, a large group of copies, a passage that unrelated texts share, short texts."""
    word = lambda: f"w{rng.randrange(4000)}"
    texts = []
    for _ in range(6):
        t = [word() for _ in range(rng.randrange(30, 160))]
        for _ in range(rng.randrange(2, 9)):
            t = list(t)
            for _ in range(rng.randrange(1, 4)):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
    base = [word() for _ in range(90)]
    for _ in range(40):
        t = list(base)
        for _ in range(rng.randrange(0, 5)):
            t[rng.randrange(len(t))] = word()
        texts.append("  ".join(t).upper())
    passage = " ".join(word() for _ in range(40))
    texts += [f"{passage} {' '.join(word() for _ in range(rng.randrange(8, 60)))}" for _ in range(60)]
    texts += ["a b c", "A  b\tc", "a b", "a", "", None, " \n", "a b c d", "x " * 500, "x " * 600, "é É é É é", "é é é é é"]
    return texts


@pytest.mark.parametrize("seen", [3, 10_000])
def test_against_brute_force(spark, monkeypatch, seen):
    monkeypatch.setattr(J, "SEEN", seen)  # with and without frequent shingles: the order must not matter
    texts = near_copies(random.Random(11))
    ids = random.Random(1).sample(range(10_000), len(texts))
    rows = [doc(i, t) for i, t in zip(ids, texts)]
    want = J.brute_force(dict(zip(ids, texts)), 4, 85)
    assert len({c for _, c in want.values()}) < len(texts) - 25
    assert answer(frame(spark, rows)) == sorted(((i, *want[i]) for i in ids), key=repr)


def test_edges(spark, edge_docs, edge_rows, no_docs):
    got = answer(edge_docs)
    assert len(got) == len(edge_rows)
    by_id = {i: c for i, _, c in got if i is not None}
    assert by_id[4] == by_id[3] == 3 and by_id[7] == 6 and by_id[9] == 8 and by_id[0] == 0 and by_id[1] == 1
    assert [c for i, _, c in got if i is None] == [None, None]
    assert answer(no_docs) == []


def test_drop_near_copies(edge_docs, no_docs):
    kept = J.drop_near_copies(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([0, 1, 2, 3, 5, 6, 8, 10, 11, None, None], key=repr)
    assert J.drop_near_copies(no_docs).collect() == []


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a = np.unique(rng.integers(0, 2 ** 63, rng.integers(1, 400)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2 ** 63, rng.integers(1, 40)).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        assert J.overlap_bound(J.bitmap(a), J.bitmap(b), len(a), len(b)) >= both


def test_texts_of_one_id_are_one_document(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [doc(1, a), doc(2, a), doc(2, b), doc(3, b), doc(3, ""), doc(5, c), doc(6, c), doc(7, ""), doc(None, a)]
    got = answer(frame(spark, rows))
    assert {(i, comp) for i, _, comp in got} == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (7, 7), (None, None)}
    assert len(got) == len(rows)


def test_copies_without_an_id_and_repeated_rows(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [doc(1, a), doc(None, a), doc(None, b), doc(None, b), doc(None, b, "other"), doc(4, c), doc(4, c), doc(4, c + " more"),
            doc(None, ""), doc(None, None), doc(7, "")]
    kept = sorted(((r.doc_id, r.text) for r in J.drop_near_copies(frame(spark, rows)).collect()), key=repr)
    assert kept == sorted([(1, a), (None, b), (4, c), (None, ""), (None, None), (7, "")], key=repr)


def candidate_pairs(spark, monkeypatch, texts):
    """The components of the texts, and how many pairs were left to compare after the leaders."""
    seen = []
    derived = J._derived_pairs
    monkeypatch.setattr(J, "_derived_pairs", lambda *a: seen.append((a[0].count(), (out := derived(*a)).count())) or out)
    got = answer(frame(spark, [doc(i, t) for i, t in enumerate(texts)]))
    return {i: c for i, _, c in got}, seen[0]


def test_a_passage_in_thousands_of_unrelated_documents(spark, monkeypatch):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [f"{passage} {' '.join(f'w{rng.randrange(10 ** 6)}' for _ in range(60))}" for _ in range(2000)]
    comp, (open_, _) = candidate_pairs(spark, monkeypatch, texts)
    assert all(i == c for i, c in comp.items()) and open_ < 2000


def test_a_large_group_below_the_threshold(spark, monkeypatch):
    """Copies that are all somewhat alike but not linked, and a few that are."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(200)]
    texts = []
    for i in range(400):
        t = list(base)
        for _ in range(rng.choice([2, 12])):
            t[rng.randrange(200)] = f"e{rng.randrange(10 ** 6)}"
        texts.append(" ".join(t))
    comp, (open_, _) = candidate_pairs(spark, monkeypatch, texts)
    want = J.brute_force(dict(enumerate(texts)), 4, 85)
    assert comp == {i: c for i, (_, c) in want.items()}
    assert open_ < 400 * 399 / 2 / 4


@pytest.mark.parametrize("k, percent", [(5, 80), (2, 60), (1, 95)])
def test_other_thresholds(spark, k, percent):
    texts = near_copies(random.Random(k))
    want = J.brute_force(dict(enumerate(texts)), k, percent)
    assert answer(frame(spark, [doc(i, t) for i, t in enumerate(texts)]), k=k, percent=percent) == sorted(((i, *v) for i, v in want.items()), key=repr)


def test_overlaps_of_long_texts_are_exact():
    rng = np.random.default_rng(4)
    a, b = (np.unique(rng.integers(0, 2 ** 64, 2_000_000, dtype=np.uint64)) for _ in range(2))
    b = np.unique(np.concatenate([b, a[:1234]]))
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([a.tobytes()], pa.binary()),
                                        pa.array([b.tobytes()], pa.binary())], names=["a", "b", "fa", "fb"])
    assert next(iter(J._overlap_rows([batch]))).column(2).to_pylist() == [1234]
