import re
from collections import Counter, defaultdict

import pytest

from strata.llm.mixing import mix_sources, mixed_documents

from .helpers import doc, frame


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Reshare the excess until no target is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    out, left, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if cap * sizes[s] <= level * w[s]}
        if not over:
            out.update({s: level * w[s] for s in open_})
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def check(rows, texts_sources):
    sizes = defaultdict(int)
    for t, s in texts_sources:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = targets(sizes), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2, (s, taken[s], want[s])


def test_targets_are_met(spark):
    rows = [doc(i, "w " * (i % 13), ["a", "B", "é", None, "z"][min(i % 9, 4)]) for i in range(600)]
    got = mix_sources(frame(spark, rows)).collect()
    check(got, [(r[1], r[3]) for r in rows])
    again = mix_sources(frame(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_edges(spark, edge_docs, edge_rows, no_docs):
    got = mix_sources(edge_docs).collect()
    assert len(got) == len(edge_rows)
    assert all(r.taken == 0 for r in got if r.size == 0)
    assert mix_sources(no_docs).collect() == []
    blank = frame(spark, [doc(1, None), doc(2, "", None)])
    assert [(r.size, r.target, r.taken) for r in mix_sources(blank).collect()] == [(0, 0.0, 0)] * 2


def test_mixed_documents_keep_their_columns(edge_docs):
    out = mixed_documents(edge_docs)
    assert out.columns == edge_docs.columns + ["mix_size", "mix_target", "mix_taken"]
    plan = Counter((r.doc_id, r.source, r.size, r.taken) for r in mix_sources(edge_docs).collect() if r.taken)
    rows = out.collect()
    assert rows and Counter((r.doc_id, r.source, r.mix_size, r.mix_taken) for r in rows) == plan


@pytest.mark.parametrize("same", [None, 7])
def test_rows_with_one_id_share_the_cut_without_loss(spark, same):
    rows = [doc(same, "w " * (1 + i % 3) + (f"x{i}" if i % 5 else ""), "abc"[i % 3]) for i in range(900)]
    rows += [doc(same, "one", "hot")] * 600
    df = frame(spark, rows).repartition(6)
    check(mix_sources(df).collect(), [(r[1], r[3]) for r in rows])
    got = sorted(map(tuple, mix_sources(df).collect()), key=repr)
    assert got == sorted(map(tuple, mix_sources(frame(spark, rows[::-1]).coalesce(1)).collect()), key=repr)
    mixed = mixed_documents(df).groupBy("source").sum("mix_taken").collect()
    taken = defaultdict(int)
    for r in got:
        taken[r[1]] += r[5]
    assert {r[0]: r[1] for r in mixed} == {s: t for s, t in taken.items() if t}


def test_one_word_rows_with_one_id(spark):
    rows = [doc(1, "w", "abc"[i % 3]) for i in range(300)]
    taken = defaultdict(int)
    for r in mix_sources(frame(spark, rows)).collect():
        taken[r.source] += r.taken
    assert [round(taken[s]) for s in "abc"] == [200, 83, 167]
