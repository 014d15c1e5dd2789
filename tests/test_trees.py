"""Histogram trees: independent of partitioning, of where nodes are finished and of joint growth;
boosting against a plain implementation; the SQL comparison is in test_oracle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.operators import trees as TR

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    r = spark.range(3000).select(
        "id", (F.xxhash64("id", F.lit(1)) % 50).cast("double").alias("a"), (F.xxhash64("id", F.lit(2)) % 7).cast("double").alias("b"),
        ((F.xxhash64("id", F.lit(3)) % 100000) / 100000).alias("c"), F.lit(1.0).alias("d"))
    label = (F.when(F.col("a") + 20 * F.col("c") > 15, 2).when(F.col("b") > 0, 1).otherwise(0)).cast("int")
    return r.withColumn("label", label).withColumn("fold", (F.col("id") % 3).cast("int"))


@pytest.fixture(scope="module")
def cuts(rows):
    return TR.feature_cuts(rows, FEATURES, 32)


@pytest.fixture(scope="module")
def table(rows, cuts):
    return TR.binned(rows, FEATURES, cuts, ["id", "label", "fold"]).cache()


def nodes_of(df):
    return sorted((r["tree"], r["node"], r["feature"], r["bin"], tuple(r["counts"])) for r in df.collect())


def settings(**kw):
    return TR.ForestSettings(**{**dict(n_features=4, classes=3, trees=4, depth=6, least=5, chosen=2, seed=1), **kw})


def test_cuts_are_quantiles(rows, cuts):
    for i, f in enumerate(FEATURES):
        v = np.sort([r[0] for r in rows.select(f).collect()])
        at = [v[int(np.ceil(j * len(v) / 32)) - 1] for j in range(1, 32)]
        assert cuts[i] == sorted(set(at) - {v[-1]}), f


def test_bins_count_the_cuts_below(rows, cuts, table):
    got = {r["id"]: list(r["bins"]) for r in table.collect()}
    for r in rows.limit(200).collect():
        assert got[r["id"]] == [sum(c < r[f] for c in cuts[i]) for i, f in enumerate(FEATURES)]


def test_same_trees_wherever_nodes_are_finished(table):
    want = nodes_of(TR.grow_forest(table, settings(), small=10 ** 9))
    assert len(want) > 40
    for small in (0, 300):
        assert nodes_of(TR.grow_forest(table, settings(), small=small)) == want
    assert nodes_of(TR.grow_forest(table.repartition(7), settings(), small=300)) == want


def test_nodes_are_consistent(table):
    s = settings()
    nodes = {(t, n): (f, b, c) for t, n, f, b, c in nodes_of(TR.grow_forest(table, s, small=200))}
    for (t, n), (f, b, c) in nodes.items():
        assert sum(c) >= s.least and n.bit_length() - 1 <= s.depth
        children = [nodes.get((t, 2 * n + side)) for side in range(2)]
        if f < 0:
            assert children == [None, None]
        else:
            assert f in s.features(t, n) and all(children)
            assert [x + y for x, y in zip(children[0][2], children[1][2])] == list(c)


def test_bootstrap_weights_are_poisson():
    w = TR.poisson_weights(np.arange(200_000), 3, 42)
    assert w.mean() == pytest.approx(1, abs=0.02) and w.var() == pytest.approx(1, abs=0.03)
    other = TR.poisson_weights(np.arange(200_000), 4, 42)
    assert abs(np.corrcoef(w, other)[0, 1]) < 0.01


def test_folds_together_equal_separate_fits(table):
    k, s = 3, settings(trees=3)
    joint = settings(trees=3, folds=k)
    together = TR.forest_scores(table, TR.grow_forest(table, joint, small=400), joint, keep=("id", "fold"))
    got = {r["id"]: r["prediction"] for r in together.collect()}
    for f in range(k):
        own = TR.forest_scores(table.where(F.col("fold") == f), TR.grow_forest(table.where(F.col("fold") != f), s), s)
        for r in own.collect():
            assert got[r["id"]] == r["prediction"]


def test_forest_learns(table):
    s = settings(trees=30, chosen=3)
    pred = TR.forest_scores(table, TR.grow_forest(table.where("fold < 2"), s), s).where("id % 3 = 2")
    assert pred.agg(F.avg((F.col("label") == F.col("prediction")).cast("int"))).first()[0] > 0.9


def test_importances_sum_to_one_and_leave_out_a_constant(table):
    imp = {r["feature"]: r["importance"] for r in TR.impurity_importances(TR.grow_forest(table, settings(chosen=4)), FEATURES).collect()}
    assert sum(imp.values()) == pytest.approx(1) and imp["d"] == 0.0 and imp["c"] > 0


def test_few_rows_and_none(table, spark):
    s = settings()
    for df in (table.limit(0), table.where("id < 3")):
        pred = TR.forest_scores(table.where("id < 20"), TR.grow_forest(df, s), s)
        assert pred.count() == 20
    nodes, prior = TR.grow_boosting(table.limit(0), TR.BoostSettings(4, 3, 2, 2, 0.1))
    assert nodes == [] and TR.boosting_scores(table.where("id < 20"), nodes, prior, TR.BoostSettings(4, 3, 2, 2, 0.1)).count() == 20


def plain_boosting(bins, labels, s):
    """The same boosting with loops over one array."""
    k, n = s.classes, len(labels)
    raw = np.tile(TR.prior_scores({c: int((labels == c).sum()) for c in range(k)}, k), (n, 1))
    out = []
    for r in range(s.rounds):
        res = TR.softmax_residuals(raw, labels)
        new = raw.copy()
        for c in range(k):
            g = res[:, c]
            h = np.floor(np.abs(g) / TR.UNIT * (1 - np.abs(g) / TR.UNIT) * TR.UNIT + 0.5)
            work = [(1, np.arange(n))]
            while work:
                node, mine = work.pop()
                best = (float(g[mine].sum()) ** 2 / len(mine) * (1 + 1e-12), -1, -1)
                if node < 2 ** s.depth:
                    for f in range(s.n_features):
                        for b in range(bins[:, f].max()):
                            left = bins[mine, f] <= b
                            nl = left.sum()
                            if 0 < nl < len(mine):
                                gl = float(g[mine][left].sum())
                                score = gl * gl / nl + (float(g[mine].sum()) - gl) ** 2 / (len(mine) - nl)
                                if score > best[0]:
                                    best = (score, f, b)
                value = 0.0 if best[1] >= 0 else TR.leaf_value(float(g[mine].sum()), float(h[mine].sum()), k, s.step)
                out.append((r * k + c, node, best[1], best[2], len(mine), round(value, 9)))
                if best[1] >= 0:
                    left = bins[mine, best[1]] <= best[2]
                    work += [(2 * node, mine[left]), (2 * node + 1, mine[~left])]
                else:
                    new[mine, c] += value
        raw = new
    return sorted(out), raw.argmax(axis=1)


def test_boosting_equals_a_plain_one(table, monkeypatch):
    monkeypatch.setattr(TR, "STATE_ROUNDS", 2)  # the scores are written within the fit
    s = TR.BoostSettings(4, 3, rounds=5, depth=3, step=0.3)
    data = table.orderBy("id").collect()
    want, pred = plain_boosting(np.array([list(r["bins"]) for r in data]), np.array([r["label"] for r in data]), s)
    nodes, prior = TR.grow_boosting(table, s)
    assert sorted((t, n, f, b, sums[2], round(v, 9)) for t, n, f, b, sums, v in nodes) == want
    scored = {r["id"]: r["prediction"] for r in TR.boosting_scores(table, nodes, prior, s).collect()}
    assert [scored[r["id"]] for r in data] == pred.tolist()


def test_boosting_does_not_depend_on_partitions(table):
    s = TR.BoostSettings(4, 3, rounds=2, depth=2, step=0.1)
    a, b = TR.grow_boosting(table.repartition(1), s), TR.grow_boosting(table.repartition(9), s)
    assert sorted(map(repr, a[0])) == sorted(map(repr, b[0])) and a[1] == b[1]


def test_hash_is_taken_modulo_the_prime():
    x = np.concatenate([np.arange(1000), TR.PRIME - 1 - np.arange(1000)]).astype(np.int64)
    want = x
    for shift, factor, plus in ((0, 48271, 11), (15, 69621, 0), (13, 16807, 0)):
        want = ((want ^ (want >> shift) if shift else want) * factor + plus) % TR.PRIME
    assert (TR.mix(x) == want).all() and TR._below(np.array([TR.PRIME, 2 * TR.PRIME, 2 ** 60])).tolist() == [0, 0, 2 ** 60 % TR.PRIME]
    ids = np.array([-5, 0, 7, 2 ** 62], dtype=np.int64)
    h = TR.mix((ids % TR.PRIME + 9 * 1_000_003 + 42 * 97) % TR.PRIME)
    assert TR.poisson_weights(ids, 8, 42).tolist() == np.searchsorted(TR.POISSON_CUTS, h, side="right").tolist()


def test_cells_without_rows_change_nothing(monkeypatch):
    rng = np.random.default_rng(1)
    bins = rng.integers(0, 200, (500, 4)).astype(np.uint8)
    labels, weights = (bins[:, 0].astype(np.int64) + rng.integers(0, 9, 500)) // 70, rng.integers(1, 4, 500)
    grown = []
    for cells in (0, 10 ** 9):
        monkeypatch.setattr(TR, "CELLS", cells)
        grown.append(TR.grow_here(settings(), 1, 1, labels, weights, bins))
    assert grown[0] == grown[1] and len(grown[0]) > 20


def test_chunks_hold_all_rows_in_order(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(TR, "CHUNK", 4)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, b)), pa.array([bytes([v, v + 1]) for v in range(a, b)], pa.binary())], names=["a", "b"])
               for a, b in ((0, 3), (3, 3), (3, 14), (14, 15))]
    got = list(TR._chunks(batches))
    assert [v for c in got for v in c.column(0).to_pylist()] == list(range(15)) and max(c.num_rows for c in got) <= 4
    assert [TR._matrix(c.column(1).slice(1), np.uint8, 2)[:, 1].tolist() for c in got] == [[v + 1 for v in c.column(0).to_pylist()[1:]] for c in got]


def test_groups_of_trees_equal_one_pass(table, spark):
    s = settings(trees=3, folds=2)
    want, sizes = nodes_of(TR.grow_forest(table, s, small=300)), []
    for gathered in (1, 4 * 3000 * 6, 10 ** 9):
        groups = TR.tree_groups(s, 3000, gathered)
        sizes.append(max(map(len, groups)))
        assert sorted(t for g in groups for t in g) == list(range(6))
        assert nodes_of(TR.grow_forest(table, s, small=300, gathered=gathered)) == want
    assert sizes == [1, 4, 6]


def test_groups_of_voters_equal_one_model(table):
    for s in (settings(trees=5), settings(trees=3, folds=3)):
        nodes = TR.grow_forest(table, s, small=300)
        want = sorted(TR.forest_scores(table, nodes, s, keep=("id",)).collect())
        assert len(want) == 3000
        for most in (1, 100):
            assert sorted(TR.forest_scores(table, nodes, s, keep=("id",), most=most).collect()) == want


def test_growth_leaves_no_shuffle_setting_behind(table, spark):
    from strata.operators.joins import FILE_CLEANUP
    before = spark.conf.get(FILE_CLEANUP)
    TR.grow_forest(table, settings(), small=300)
    assert spark.conf.get(FILE_CLEANUP) == before
