import numpy as np
import pytest

from strata.llm import vectors as V

SCHEMA = "vec_id long, embedding array<float>, label int, id long, rank int, dim int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3) for i, v in rows], SCHEMA)


def brute(rows, k, every):
    good = {i: np.array(v, np.float64) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in good:
        if q % every == 0:
            score = sorted((-float(good[q] @ good[i]), i) for i in good if i != q and len(good[i]) == len(good[q]))
            out[q] = [(i, -s) for s, i in score[:k]]
    return out


@pytest.mark.parametrize("block", [97, 16384])
def test_recall_against_brute_force(spark, block):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 64))
    rows = [(i, [float(np.float32(x)) for x in base[i % 12] + 0.6 * rng.standard_normal(64)]) for i in range(1500)]
    rows += [(i, rows[100][1]) for i in range(1500, 1600)]  # one vector many times: ties
    want = brute(rows, 20, 20)
    got = {}
    for r in V.nearest(table(spark, rows), block_rows=block).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        score = {i: s for i, s in want[q]}
        hit += sum(i in score for _, i, _ in found)
        for _, i, s in found:
            assert s == pytest.approx(float(np.array(rows[i][1]) @ np.array(rows[q][1])), rel=1e-12)
    assert hit / (20 * len(want)) >= 0.98


def test_estimates_stay_within_their_bounds():
    rng = np.random.default_rng(8)
    x, q = rng.standard_normal((2000, 48)) * rng.random((2000, 1)) * 9, rng.standard_normal((20, 48))
    value, error = V.Codes(x).estimate(q)
    assert (np.abs(value - q @ x.T) <= error).mean() > 0.97


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]),
            (7, []), (None, [1.0, 1.0]), (8, [1.0, 1.0]), (8, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (20, [-1.0, 0.5]), (40, [1.0, 1.0, 1.0])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in V.nearest(table(spark, rows)).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 8, 1.0), (0, 3, 20, -1.0), (20, 1, 1, -0.5), (20, 2, 8, -0.5), (20, 3, 0, -1.0),
                   (40, 1, 9, 6.0)]
    assert V.nearest(table(spark, [])).collect() == []
