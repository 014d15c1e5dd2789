"""Histogram trees grown on Spark: random forest, its cross-validation, multinomial boosting.

Rows are binned once: every feature is cut at exact quantiles of its values, and a row is one byte
per feature. Trees grow level by level, all trees of a fit together: a task counts the rows of its
part into one histogram per open node, equal nodes of all tasks are summed, and the best cut of
each node is one row. Nothing but the table of nodes reaches the driver. A forest node with
few rows left is finished where its rows are gathered, so deep levels need no pass of their own.
Every row is used; a forest too large for one pass grows and votes in groups of trees.

Every sum is over whole numbers (class counts; gradients in units of 2^-24), so the trees do not
depend on partitions, retries or the order of rows, and a SQL statement can state them exactly.
Randomness is a hash of row key, tree and node: bootstrap weights are Poisson(1) by that hash.

The node table: ``tree``, ``node`` (1 is the root, its children are 2 and 3), ``feature`` (-1 in a
leaf) and ``bin`` (rows with a bin up to it go left), ``counts``.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F, types as T

from strata.operators.joins import materialize, shuffles_dropped
from strata.operators.windows import bucketed_prefix_sum, value_bucketed
from strata.sources.sinks import delete_folder, shared_scratch

PRIME = 2 ** 31 - 1  # the hash works modulo this, so its products fit 64 bits in any engine
POISSON_CUTS = [int(PRIME * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(10)]
UNIT = float(1 << 24)        # gradients are whole multiples of 1 / UNIT
SMALL_NODE = 262_144         # weighted rows up to which a forest node is finished in one task
GATHERED = 8 << 30           # bytes of rows that the trees which grow together gather at most
MODEL_NODES = 1_000_000      # rows of the node table that the driver or a scoring task holds at once
SCORED = 524_288             # rows that a scoring task holds at once
STATE_ROUNDS = 5             # boosting rounds after which the rows' scores are written
CHUNK = 16_384               # rows that a task works on at once (sums of curvatures and rows share a double up to here)
CELLS = 2                    # cells per row up to which a finished node's cells are not looked up by sorting
VOTE = 1_000_000             # a leaf's class shares are whole multiples of 1 / VOTE

NODES = "tree int, node int, feature int, bin int, counts array<bigint>"


# --- hashing and binning ------------------------------------------------------------------

def mix(x):
    """A well-spread number below PRIME from one below PRIME (numpy int64)."""
    x = _below(x * 48271 + 11)
    x = _below((x ^ (x >> 15)) * 69621)
    return _below((x ^ (x >> 13)) * 16807)


def _below(x):
    """x % PRIME of whole numbers from 0 below 2^61: PRIME is 2^31 - 1, so 2^31 counts as 1."""
    x = (x & PRIME) + (x >> 31)
    return x - PRIME * (x >= PRIME)


def poisson_weights(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Bootstrap weights of rows in a tree: Poisson(1) by a hash of (id, tree, seed)."""
    h = mix(_below(ids % PRIME + ((tree + 1) * 1_000_003 + seed * 97) % PRIME))
    weights = np.zeros(len(h), dtype=np.uint8)
    for cut in POISSON_CUTS:
        weights += h >= cut
    return weights


def node_features(tree: int, node: int, n_features: int, n_chosen: int, seed: int) -> list[int]:
    """The features a node may use: those with the smallest hashes, in ascending order."""
    if n_chosen >= n_features:
        return list(range(n_features))
    start = (tree * 131_071 + node * 8191 + seed * 97 + np.arange(n_features, dtype=np.int64) * 524_287) % PRIME
    return sorted(np.lexsort((np.arange(n_features), mix(start)))[:n_chosen].tolist())


def feature_cuts(rows: DataFrame, features: Sequence[str], max_bins: int) -> list[list[float]]:
    """Per feature at most ``max_bins - 1`` ascending cuts: the values at which the running count of
    rows passes i/max_bins of all rows, without the largest value. Exact, from the histogram of
    values; its running counts are spread over value buckets."""
    pairs = F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v")) for i, c in enumerate(features)])
    hist = materialize(rows.select(F.inline(pairs)).groupBy("f", "v").agg(F.count(F.lit(1)).alias("c")), "values")
    run = bucketed_prefix_sum(value_bucketed(hist, "v", ["f"], 64), ["f"], [F.asc("v")], [F.col("__vb")], "before",
                              weight=F.col("c"), exclusive=True, total_name="n")
    passed = lambda upto: F.floor(upto * max_bins / F.col("n"))
    upto = F.col("before") + F.col("c")
    cuts = run.where((upto < F.col("n")) & (passed(upto) > passed(F.col("before")))).select("f", "v")
    out = [[] for _ in features]
    for r in cuts.orderBy("f", "v").collect():  # at most features x (max_bins - 1)
        out[r["f"]].append(r["v"])
    return out


def binned(rows: DataFrame, features: Sequence[str], cuts: list[list[float]], keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``bins``: one byte per feature, the number of cuts below its value."""
    arrays = [np.array(c) for c in cuts]

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            bins = np.zeros((n, len(arrays)), dtype=np.uint8)
            for i, c in enumerate(arrays):
                bins[:, i] = np.searchsorted(c, batch.column(len(keep) + i).to_numpy(zero_copy_only=False), side="left")
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], _blobs(bins)], names=[*keep, "bins"])

    source = rows.select(*keep, *[F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(features)])
    schema = T.StructType([*source.select(*keep).schema.fields, T.StructField("bins", T.BinaryType())])
    return source.mapInArrow(run, schema)


def _blobs(matrix: np.ndarray) -> pa.Array:
    """One binary value per row of a matrix."""
    matrix = np.ascontiguousarray(matrix)
    n, width = len(matrix), matrix.dtype.itemsize * (matrix.shape[1] if matrix.ndim > 1 else 1)
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(matrix.tobytes())])


def _matrix(column: pa.Array, dtype, width: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, width), dtype=dtype)
    starts = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[starts[0]:starts[-1]].view(dtype).reshape(-1, width)


def _chunks(batches):
    """The rows of the batches in batches of CHUNK rows, the last one smaller."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            if n + part.num_rows > CHUNK:
                yield pa.concat_batches(held)
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if held:
        yield pa.concat_batches(held)


# --- the node table in tasks ----------------------------------------------------------------

class Trees:
    """A node table as arrays; children of one node stand side by side."""

    def __init__(self, rows: Sequence[tuple]):
        self._fill(*np.array([r[:4] for r in rows], dtype=np.int64).reshape(-1, 4).T)

    @classmethod
    def of_arrays(cls, *columns: np.ndarray) -> Trees:
        """Like the constructor, from one array each of tree, node, feature and bin."""
        trees = cls.__new__(cls)
        trees._fill(*[c.astype(np.int64) for c in columns])
        return trees

    def _fill(self, tree, node, feature, bin_) -> None:
        self.order = np.lexsort((node, tree))  # the table's rows by tree and node
        self.tree, self.node, self.feature, self.bin = (c[self.order] for c in (tree, node, feature, bin_))
        key, n = (self.tree << 32) + self.node, len(self.tree)
        child = (self.tree << 32) + 2 * self.node
        at = np.minimum(np.searchsorted(key, child), max(n - 1, 0))
        left = np.where(key[at] == child, at, -1) if n else at
        # a row that has reached its leaf stays there: no bin is above 255
        leaf = self.feature < 0
        self.next, self.cut = np.where(leaf, np.arange(n), left), np.where(leaf, 255, self.bin).astype(np.uint8)
        self.tested = np.where(leaf, 0, self.feature)
        first = np.flatnonzero(self.node == 1)
        self.root = dict(zip(self.tree[first].tolist(), first.tolist()))
        ends = np.append(np.flatnonzero(np.diff(self.tree)), n - 1) if n else []
        self.depth = {int(self.tree[e]): int(self.node[e]).bit_length() - 1 for e in ends}

    def walk_only(self) -> tuple:
        """What :meth:`places` needs, in few bytes and plain types."""
        return self.next.astype(np.int32), self.cut, self.tested.astype(np.uint8), self.root, self.depth

    @classmethod
    def walking(cls, *parts) -> Trees:
        trees = cls.__new__(cls)
        trees.next, trees.cut, trees.tested, trees.root, trees.depth = parts
        return trees

    def places(self, tree: int, bins: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """The table row of the leaf in which each row of ``bins``, or each of ``rows``, falls."""
        flat, width = np.ascontiguousarray(bins).reshape(-1), bins.shape[1]
        start = (np.arange(len(bins)) if rows is None else rows) * width
        at = np.full(len(start), self.root[tree], dtype=np.int64)
        for _ in range(self.depth[tree]):
            at = self.next.take(at) + (flat.take(start + self.tested.take(at)) > self.cut.take(at))
        return at


def best_cut(hist: np.ndarray, least: int, stats: int):
    """The best cut of one feature from its histogram (bins, columns): the first ``stats`` columns
    are the target's sums, the last is the row count. Returns (score, bin, left sums) or None."""
    left = hist.cumsum(axis=0)
    total = left[-1]
    nl, nr = left[:, -1], total[-1] - left[:, -1]
    ok = (nl >= least) & (nr >= least)
    if not ok.any():
        return None
    l, r = left[:, :stats].astype(np.float64), (total - left)[:, :stats].astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (l * l).sum(axis=1) / nl + (r * r).sum(axis=1) / nr
    score = np.where(ok, score, -np.inf)
    at = int(score.argmax())
    return float(score[at]), at, left[at]


def split_node(hists: Sequence[tuple[int, np.ndarray]], least: int, stats: int):
    """(feature, bin, left sums, total) of a node's best cut over its features' histograms, ties to
    the earlier feature and smaller bin; feature -1 if no cut is better than none."""
    total = hists[0][1].sum(axis=0)
    base = float((total[:stats].astype(np.float64) ** 2).sum() / total[-1])
    best = None
    for f, hist in hists:
        found = best_cut(hist, least, stats)
        if found and found[0] > base * (1 + 1e-12) and (best is None or found[0] > best[0]):
            best = (found[0], f, found[1], found[2])
    return (-1, -1, None, total) if best is None else (*best[1:], total)


# --- random forest ------------------------------------------------------------------------------

class ForestSettings:
    """What a forest is grown with; ``folds`` fits share the passes (tree t belongs to fold t // trees)."""

    def __init__(self, n_features: int, classes: int, trees: int, depth: int, least: int, chosen: int, seed: int, folds: int = 0):
        self.n_features, self.classes, self.trees, self.depth = n_features, classes, trees, depth
        self.least, self.chosen, self.seed, self.folds = least, chosen, seed, folds

    @property
    def all_trees(self) -> int:
        return self.trees * max(1, self.folds)

    def drawn(self, trees: Sequence[int], ids: np.ndarray, folds):
        """(tree, rows of weight, their weights) of each of ``trees``; folds share a tree's weights."""
        for own in sorted({t % self.trees for t in trees}):
            w = poisson_weights(ids, own, self.seed)
            rows = np.flatnonzero(w)
            w, fold = w[rows], folds[rows]
            for tree in [t for t in trees if t % self.trees == own]:
                seen = np.flatnonzero(fold != tree // self.trees) if self.folds else slice(None)
                yield tree, rows[seen], w[seen]

    def features(self, tree: int, node: int) -> list[int]:
        return node_features(tree % self.trees, node, self.n_features, self.chosen, self.seed)


def _forest_columns(batch, settings: ForestSettings):
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    labels = batch.column(1).to_numpy(zero_copy_only=False)
    folds = batch.column(2).to_numpy(zero_copy_only=False)
    return ids, labels, folds, _matrix(batch.column(3), np.uint8, settings.n_features)


def _open_nodes(trees: Trees | None, wanted: dict) -> np.ndarray | None:
    """Per table row the place of its node among its tree's ``wanted`` ones, -1 for another; None at the roots."""
    if trees is None:
        return None
    slots = {(t, n): i for t, nodes in wanted.items() for i, n in enumerate(nodes)}
    return np.array([slots.get(key, -1) for key in zip(trees.tree.tolist(), trees.node.tolist())], dtype=np.int64)


def _in_nodes(trees: Trees | None, slots: np.ndarray | None, tree: int, bins: np.ndarray, rows: np.ndarray, w: np.ndarray):
    """(rows, their weights, their nodes' places among the wanted ones) of the rows in a wanted node."""
    if trees is None:
        return rows, w, np.zeros(len(rows), dtype=np.int64)
    slot = slots.take(trees.places(tree, bins, rows))
    mine = np.flatnonzero(slot >= 0)
    return rows[mine], w[mine], slot[mine]


def _count_nodes(settings: ForestSettings, nodes: list, open_nodes: dict):
    """Per task one histogram blob (chosen features, 256 bins, classes) per open node."""
    def run(batches):
        trees, sums, k = Trees(nodes) if nodes else None, {}, settings.classes
        slots = _open_nodes(trees, open_nodes)
        chosen = {t: np.array([settings.features(t, n) for n in wanted]) for t, wanted in open_nodes.items()}
        for batch in _chunks(batches):
            ids, labels, folds, bins = _forest_columns(batch, settings)
            flat = np.ascontiguousarray(bins).reshape(-1)
            for tree, rows, w in settings.drawn(list(open_nodes), ids, folds):
                rows, w, slot = _in_nodes(trees, slots, tree, bins, rows, w)
                if not len(rows):
                    continue
                wanted, label, start = len(open_nodes[tree]), labels[rows].astype(np.int64), rows * settings.n_features
                if tree not in sums:
                    sums[tree] = np.zeros((wanted, settings.chosen, 256 * k), dtype=np.int64)
                w, cell = w.astype(np.float64), slot * (256 * k) + label
                for place in range(settings.chosen):
                    b = flat.take(start + chosen[tree][:, place].take(slot))
                    part = np.bincount(cell + b.astype(np.int64) * k, weights=w, minlength=wanted * 256 * k)
                    sums[tree][:, place] += part.astype(np.int64).reshape(wanted, -1)
        for tree in list(sums):
            for node, hist in zip(open_nodes[tree], sums.pop(tree)):
                if hist[0].any():
                    yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([node], pa.int32()),
                                                      pa.array([hist.tobytes()], pa.binary())], names=["tree", "node", "hist"])
    return run


def _split_nodes(settings: ForestSettings):
    """The summed histogram of a node -> its row of the node table, and its children's sizes."""
    def run(table: pa.Table) -> pa.Table:
        tree, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        hist = sum(np.frombuffer(h.as_py(), dtype=np.int64) for h in table.column("hist"))
        hist = hist.reshape(settings.chosen, 256, settings.classes)
        hist = np.concatenate([hist, hist.sum(axis=2, keepdims=True)], axis=2)
        f, b, left, total = split_node(list(zip(settings.features(tree, node), hist)), settings.least, settings.classes)
        sizes = [0, 0] if f < 0 else [int(left[-1]), int(total[-1] - left[-1])]
        # a leaf's counts are known here; those of the children come with their own histograms
        children = [] if f < 0 else [left[:-1].tolist(), (total - left)[:-1].tolist()]
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()),
                         "feature": pa.array([f], pa.int32()), "bin": pa.array([b], pa.int32()),
                         "counts": pa.array([total[:-1].tolist()], pa.list_(pa.int64())),
                         "sizes": pa.array([sizes], pa.list_(pa.int64())),
                         "children": pa.array([children], pa.list_(pa.list_(pa.int64())))})
    return run


def _gather_nodes(settings: ForestSettings, nodes: list, small: dict):
    """Per task one blob of rows (label, weight, bins) per small node."""
    def run(batches):
        trees = Trees(nodes) if nodes else None
        slots = _open_nodes(trees, small)
        for batch in _chunks(batches):
            ids, labels, folds, bins = _forest_columns(batch, settings)
            # the weight's byte differs by tree
            packed = np.hstack([labels[:, None].astype(np.uint8), np.zeros((len(labels), 1), np.uint8), bins])
            for tree, rows, w in settings.drawn(list(small), ids, folds):
                rows, w, slot = _in_nodes(trees, slots, tree, bins, rows, w)
                if not len(rows):
                    continue
                order = np.argsort(slot.astype(np.uint16) if len(small[tree]) < 2 ** 16 else slot, kind="stable")
                own = packed.take(rows[order], axis=0)
                own[:, 1] = w[order]
                found = np.bincount(slot, minlength=len(small[tree]))
                there = np.flatnonzero(found)
                offsets = np.concatenate([[0], np.cumsum(found[there])]).astype(np.int32) * own.shape[1]
                blobs = pa.Array.from_buffers(pa.binary(), len(there), [None, pa.py_buffer(offsets), pa.py_buffer(own.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(there), tree), pa.int32()), pa.array(np.array(small[tree])[there], pa.int32()), blobs],
                    names=["tree", "node", "rows"])
    return run


def grow_here(settings: ForestSettings, tree: int, node: int, labels: np.ndarray, weights: np.ndarray, bins: np.ndarray) -> list:
    """The subtree under ``node`` from its rows, as rows of the node table.

    Level by level like the distributed growth. The cells of a feature's histograms are as many as
    it has bins, node by node; where they are many more than the rows, only those with rows are
    kept, so the work follows the rows and not the number of bins."""
    out, k, level = [], settings.classes, node.bit_length() - 1
    n_bins = bins.max(axis=0).astype(np.int64) + 1
    flat, start, weights = np.ascontiguousarray(bins).reshape(-1), np.arange(len(bins)) * bins.shape[1], weights.astype(np.float64)
    # the open nodes, their class sums (whole numbers, exact in doubles) and each row's place among them
    open_, local = np.array([node]), np.zeros(len(labels), dtype=np.int64)
    totals = np.bincount(labels, weights=weights, minlength=k)[None, :]
    while len(open_):
        score = (totals ** 2).sum(axis=1) / totals.sum(axis=1) * (1 + 1e-12)
        feature, cut = np.full(len(open_), -1), np.full(len(open_), -1)
        lefts = np.zeros_like(totals)
        if level < settings.depth:
            chosen = np.array([settings.features(tree, int(v)) for v in open_])
            for slot in range(settings.chosen):
                own = chosen[:, slot]
                first = np.concatenate([[0], np.cumsum(n_bins[own])])  # where the cells of each node begin
                cell = first.take(local) + flat.take(start + own.take(local))
                if first[-1] <= CELLS * len(cell):
                    used, who = np.arange(first[-1]), np.repeat(np.arange(len(open_)), n_bins[own])
                else:
                    used, cell = np.unique(cell, return_inverse=True)
                    who = np.searchsorted(first, used, side="right") - 1
                sums = np.bincount(cell * k + labels, weights=weights, minlength=len(used) * k).reshape(-1, k)
                run, starts = sums.cumsum(axis=0), np.searchsorted(who, np.arange(len(open_)))
                left = run - (run[starts] - sums[starts])[who]
                right = totals[who] - left
                nl, nr = left.sum(axis=1), right.sum(axis=1)
                ok = (nl >= settings.least) & (nr >= settings.least)
                with np.errstate(divide="ignore", invalid="ignore"):
                    s = np.where(ok, (left * left).sum(axis=1) / nl + (right * right).sum(axis=1) / nr, -np.inf)
                # the first of the best cuts of each node
                hits = np.flatnonzero(s == np.maximum.reduceat(s, starts)[who])
                hits = hits[np.searchsorted(who[hits], np.arange(len(open_)))]
                better = np.flatnonzero(s[hits] > score)
                at = hits[better]
                score[better], feature[better], lefts[better] = s[at], own[better], left[at]
                cut[better] = used[at] - first[better]
        out += zip([tree] * len(open_), open_.tolist(), feature.tolist(), cut.tolist(), totals.astype(np.int64).tolist())
        go = np.flatnonzero(feature >= 0)
        open_ = np.stack([2 * open_[go], 2 * open_[go] + 1], axis=1).reshape(-1)
        totals = np.stack([lefts[go], totals[go] - lefts[go]], axis=1).reshape(-1, k)
        place = np.full(len(feature), -1, dtype=np.int64)
        place[go] = 2 * np.arange(len(go))
        rows = np.flatnonzero(feature.take(local) >= 0)
        local, start, labels, weights = local[rows], start[rows], labels[rows], weights[rows]
        local = place.take(local) + (flat.take(start + feature.take(local)) > cut.take(local))
        level += 1
    return out


def _finish_nodes(settings: ForestSettings):
    def run(table: pa.Table) -> pa.Table:
        tree, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        rows = np.frombuffer(b"".join(r.as_py() for r in table.column("rows")), dtype=np.uint8)
        rows = rows.reshape(-1, settings.n_features + 2)
        grown = grow_here(settings, tree, node, rows[:, 0].astype(np.int64), rows[:, 1].astype(np.int64), rows[:, 2:])
        cols = list(zip(*grown))
        return pa.table({"tree": pa.array(cols[0], pa.int32()), "node": pa.array(cols[1], pa.int32()),
                         "feature": pa.array(cols[2], pa.int32()), "bin": pa.array(cols[3], pa.int32()),
                         "counts": pa.array(cols[4], pa.list_(pa.int64()))})
    return run


def tree_groups(settings: ForestSettings, n: int, gathered: int) -> list[list[int]]:
    """The trees in groups that grow together on ``n`` rows, each with at most ``gathered`` bytes of rows
    (one tree at least). A tree's folds share its weights, so they stand side by side."""
    order = sorted(range(settings.all_trees), key=lambda t: (t % settings.trees, t))
    size = max(1, gathered // max(1, n * (settings.n_features + 2)))
    return [order[at:at + size] for at in range(0, len(order), size)]


def grow_forest(rows: DataFrame, settings: ForestSettings, small: int = SMALL_NODE, gathered: int = GATHERED) -> DataFrame:
    """The node table of a forest on binned rows (``id``, ``label``, ``fold``, ``bins``), written.

    Nodes with more than ``small`` weighted rows are cut from summed histograms, one pass per
    level; smaller ones are finished from their gathered rows, one task per group of nodes. The
    driver sees the cuts of large nodes only. All rows are used: where the trees together would gather
    more than ``gathered`` bytes, they grow in groups, and a group's shuffle files go when it is done."""
    source = rows.select("id", "label", "fold", "bins")
    session, n = source.sparkSession, source.count()
    path = shared_scratch(session, "forest")
    with shuffles_dropped(session):
        for trees in tree_groups(settings, n, gathered):
            _grow_trees(source, settings, trees, n, small).write.mode("append").parquet(path)
    return session.read.schema(NODES).parquet(path)


def _grow_trees(source: DataFrame, settings: ForestSettings, trees: Sequence[int], n: int, small: int) -> DataFrame:
    """The node table of ``trees`` on the ``n`` rows of ``source``."""
    table, closed, finish = [], [], {}
    open_ = {t: [1] for t in trees} if n > small else {}
    if not open_:
        finish = {t: [1] for t in trees}
    level = 0
    while open_:
        counted = source.mapInArrow(_count_nodes(settings, table + closed, open_), "tree int, node int, hist binary")
        split = counted.groupBy("tree", "node").applyInArrow(
            _split_nodes(settings), NODES + ", sizes array<bigint>, children array<array<bigint>>").collect()
        next_, closed, level = {}, [], level + 1  # the open nodes have their own rows now
        for r in split:
            table.append((r["tree"], r["node"], r["feature"], r["bin"], list(r["counts"])))
            for side in range(2 if r["feature"] >= 0 else 0):
                child = 2 * r["node"] + side
                closed.append((r["tree"], child, -1, -1, list(r["children"][side])))
                if level >= settings.depth:
                    continue  # stays a leaf
                (next_ if r["sizes"][side] > small else finish).setdefault(r["tree"], []).append(child)
        # open children are cut in the next pass; until then they are leaves of the partial trees
        again = {(t, c) for t, cs in next_.items() for c in cs}
        table += [r for r in closed if (r[0], r[1]) not in again]
        closed = [r for r in closed if (r[0], r[1]) in again]
        open_ = next_
    grown = {(t, c) for t, cs in finish.items() for c in cs}
    top = source.sparkSession.createDataFrame([r for r in table if (r[0], r[1]) not in grown], NODES)
    if grown:
        gathered = source.mapInArrow(_gather_nodes(settings, table, finish), "tree int, node int, rows binary")
        top = top.unionByName(gathered.groupBy("tree", "node").applyInArrow(_finish_nodes(settings), NODES))
    return top


def _voters(nodes: DataFrame, settings: ForestSettings, most: int) -> list:
    """The node table as broadcasts, each of whole trees with at most ``most`` nodes (one tree at least)
    and the votes of every node. The driver holds one of them at a time."""
    groups, held = [], 0
    for r in nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).orderBy("tree").collect():
        if not groups or held + r["n"] > most:
            groups.append([])
            held = 0
        groups[-1].append(r["tree"])
        held += r["n"]
    out = []
    for own in groups:
        model = nodes.where(F.col("tree").between(own[0], own[-1])).select("tree", "node", "feature", "bin", "counts").toArrow()
        trees = Trees.of_arrays(*[model[c].to_numpy() for c in ("tree", "node", "feature", "bin")])
        counts = model["counts"].combine_chunks().flatten().to_numpy().reshape(-1, settings.classes)[trees.order]
        votes = counts * VOTE // np.maximum(counts.sum(axis=1, keepdims=True), 1)
        out.append(nodes.sparkSession.sparkContext.broadcast((*trees.walk_only(), votes.astype(np.int32))))
    return out


def _blocks(batches, most: int):
    """The batches in lists of about ``most`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def forest_scores(rows: DataFrame, nodes: DataFrame, settings: ForestSettings, keep: Sequence[str] = ("id", "label"),
                  most: int = MODEL_NODES) -> DataFrame:
    """``keep`` and ``prediction``, written: the class with the most votes, ties to the smaller class. A
    tree votes with the class shares of the row's leaf, as whole multiples of 1 / VOTE. With folds, a
    row is scored by the trees that have not seen it.

    The node table is the model: at most trees x 2^(depth + 1) rows, whatever the data. A task lets
    the trees vote in groups of at most ``most`` nodes, one group after the other."""
    voters = _voters(nodes, settings, most)

    def run(batches):
        for block in _blocks(_chunks(batches), SCORED):
            folds = [b.column(len(keep)).to_numpy(zero_copy_only=False) for b in block]
            bins = [_matrix(b.column(len(keep) + 1), np.uint8, settings.n_features) for b in block]
            totals = [np.zeros((len(b), settings.classes), dtype=np.int64) for b in bins]
            own = [{f: np.flatnonzero(fold == f) for f in range(settings.folds)} for fold in folds]
            for voter in voters:
                *parts, votes = voter.value
                trees = Trees.walking(*parts)
                for total, b, mine in zip(totals, bins, own):
                    for tree in sorted(trees.root):  # a tree without a row in its sample has no vote
                        if not settings.folds:
                            total += votes.take(trees.places(tree, b), axis=0)
                            continue
                        seen = mine[tree // settings.trees]
                        total[seen] += votes.take(trees.places(tree, b, seen), axis=0)
                if len(voters) > 1 and getattr(voter, "_path", None):
                    del parts, votes, trees
                    vars(voter).pop("_value", None)  # the next one takes its place; it lies in a file of the worker
            for batch, total in zip(block, totals):
                best = pa.array(total.argmax(axis=1).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], best], names=[*keep, "prediction"])

    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField("prediction", T.DoubleType())])
    scored = materialize(rows.select(*keep, "fold", "bins").mapInArrow(run, schema), "scored")
    for voter in voters:
        voter.destroy()
    return scored


def impurity_importances(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, importance): per tree the weighted impurity decreases of the nodes that use a
    feature as a share of the tree's, averaged over the trees that have a cut. One join of the
    node table with its children."""
    n = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)
    squares = F.aggregate("counts", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    own = nodes.select("tree", "node", "feature", (squares / n).alias("s"))
    child = own.select("tree", F.floor(F.col("node") / 2).cast("int").alias("node"), F.col("s").alias("cs"))
    gains = (own.where("feature >= 0").join(child.groupBy("tree", "node").agg(F.sum("cs").alias("cs")), ["tree", "node"])
             .groupBy("tree", "feature").agg(F.sum(F.col("cs") - F.col("s")).alias("gain")))
    share = gains.withColumn("share", F.col("gain") / F.sum("gain").over(Window.partitionBy("tree")))
    trees = own.where("feature >= 0").agg(F.count_distinct("tree").alias("t")).scalar()
    names = nodes.sparkSession.createDataFrame(list(enumerate(features)), "feature int, name string")
    return (F.broadcast(names).join(share.groupBy("feature").agg((F.sum("share") / trees).alias("importance")), "feature", "left")
            .select(F.col("name").alias("feature"), F.coalesce("importance", F.lit(0.0)).alias("importance")))


# --- multinomial boosting --------------------------------------------------------------------

class BoostSettings:
    def __init__(self, n_features: int, classes: int, rounds: int, depth: int, step: float, least: int = 1):
        self.n_features, self.classes, self.rounds, self.depth, self.step, self.least = n_features, classes, rounds, depth, step, least


def softmax_residuals(raw: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """One-hot label less class probability, in whole units of 1 / UNIT."""
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    p = -p
    p[np.arange(len(labels)), labels] += 1.0
    return np.floor(p * UNIT + 0.5).astype(np.int64)


def leaf_value(residuals: float, curvature: float, classes: int, step: float) -> float:
    """One Newton step of a leaf for its class's score, shrunk by ``step``."""
    if curvature < 1e-9:
        return 0.0
    return step * ((classes - 1) / classes) * (residuals / curvature)


def add_trees(raw: np.ndarray, bins: np.ndarray, trees: Trees | None, values: np.ndarray, classes: int) -> np.ndarray:
    """``raw`` with the leaf values of all ``trees`` added, in the order of the trees."""
    if trees is not None:
        raw = raw.copy()
        for tree in sorted(trees.root):
            raw[:, tree % classes] += values[trees.places(tree, bins)]
    return raw


def _with_values(nodes: list):
    order = sorted(nodes, key=lambda r: (r[0], r[1]))
    return (Trees(order), np.array([r[5] for r in order])) if nodes else (None, np.zeros(0))


def _boost_rows(batch, settings: BoostSettings, trees: Trees | None, values: np.ndarray):
    labels = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
    bins = _matrix(batch.column(2), np.uint8, settings.n_features)
    raw = _matrix(batch.column(3), np.float64, settings.classes)
    return labels, bins, add_trees(raw, bins, trees, values, settings.classes)


def _count_gradients(settings: BoostSettings, before: list, partial: list, round_: int):
    """Per task and open node one blob: per feature and bin the sums of residual, curvature, rows."""
    def run(batches):
        sums, k = {}, settings.classes
        trees, newest = Trees(partial) if partial else None, _with_values(before)
        leaves = {}  # per tree its leaves, and the place of each table row among them
        for tree in range(round_ * k, (round_ + 1) * k):
            at = np.flatnonzero((trees.tree == tree) & (trees.feature < 0)) if trees else np.zeros(1, dtype=np.int64)
            place = np.zeros(len(trees.tree) if trees else 1, dtype=np.int64)
            place[at] = np.arange(len(at))
            leaves[tree] = trees.node[at].tolist() if trees else [1], place
        for batch in _chunks(batches):
            labels, bins, raw = _boost_rows(batch, settings, *newest)
            r, columns = softmax_residuals(raw, labels), np.ascontiguousarray(bins.T)
            for c in range(k):
                tree = round_ * k + c
                nodes, place = leaves[tree]
                first = place.take(trees.places(tree, bins)) * 256 if trees else np.zeros(len(bins), dtype=np.int64)
                own = np.abs(r[:, c]) / UNIT
                curve = np.floor(own * (1.0 - own) * UNIT + 0.5)
                # whole numbers below 2^53 are summed exactly in doubles; a curvature is at most 2^22, so those of a
                # chunk stay below 2^37, and above them a double has room for the number of rows
                residual, both = r[:, c].astype(np.float64), curve + 2.0 ** 37
                if tree not in sums:
                    sums[tree] = np.zeros((len(nodes), settings.n_features, 256, 3), dtype=np.int64)
                for f in range(settings.n_features):
                    cell = first + columns[f]
                    packed = np.bincount(cell, weights=both, minlength=256 * len(nodes)).astype(np.int64).reshape(-1, 256)
                    hist = sums[tree][:, f]
                    hist[:, :, 0] += np.bincount(cell, weights=residual, minlength=256 * len(nodes)).astype(np.int64).reshape(-1, 256)
                    hist[:, :, 1] += packed & (2 ** 37 - 1)
                    hist[:, :, 2] += packed >> 37
        for tree, hists in sums.items():
            for node, hist in zip(leaves[tree][0], hists):
                if hist[0, :, 2].any():
                    yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([node], pa.int32()),
                                                      pa.array([hist.tobytes()], pa.binary())], names=["tree", "node", "hist"])
    return run


BOOST_SPLIT = "tree int, node int, feature int, bin int, total array<bigint>, left array<bigint>"


def _split_gradients(settings: BoostSettings):
    def run(table: pa.Table) -> pa.Table:
        hist = sum(np.frombuffer(h.as_py(), dtype=np.int64) for h in table.column("hist")).reshape(settings.n_features, 256, 3)
        f, b, left, total = split_node([(i, h[:, [0, 2]]) for i, h in enumerate(hist)], settings.least, 1)
        total = hist[0].sum(axis=0)
        left = hist[f, :b + 1].sum(axis=0) if f >= 0 else np.zeros(3, dtype=np.int64)
        return pa.table({"tree": table.column("tree").slice(0, 1), "node": table.column("node").slice(0, 1),
                         "feature": pa.array([f], pa.int32()), "bin": pa.array([b], pa.int32()),
                         "total": pa.array([total.tolist()], pa.list_(pa.int64())), "left": pa.array([left.tolist()], pa.list_(pa.int64()))})
    return run


def _scored_state(settings: BoostSettings, nodes: list):
    def run(batches):
        newest = _with_values(nodes)
        for batch in batches:
            _, _, raw = _boost_rows(batch, settings, *newest)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _blobs(raw)], names=["id", "label", "bins", "raw"])
    return run


STATE = "id bigint, label int, bins binary, raw binary"


def prior_scores(counts: dict[int, int], classes: int) -> list[float]:
    """Log shares of the classes: where boosting starts. A class without rows starts far below."""
    n = sum(counts.values())
    return [math.log(counts[c] / n) if counts.get(c) else -50.0 for c in range(classes)]


def _start(rows: DataFrame, prior: Sequence[float]) -> DataFrame:
    start = np.array(prior, dtype=np.float64).tobytes()
    return rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), "bins",
                       F.lit(bytearray(start)).alias("raw"))


def _state(df: DataFrame) -> tuple[DataFrame, str]:
    """The rows' scores, written, and their folder."""
    path = shared_scratch(df.sparkSession, "boost")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def grow_boosting(rows: DataFrame, settings: BoostSettings) -> tuple[list[tuple], list[float]]:
    """Multinomial boosting on binned rows (``id``, ``label``, ``bins``): softmax loss, one tree per
    class and round, all classes of a round from the same scores. Returns the node table (tree, node,
    feature, bin, [residual, curvature, rows], value) and the starting scores; tree t is round
    t // classes for class t % classes.

    Each level of a round is one pass of the rows. The rows' scores are written every STATE_ROUNDS
    rounds, in place of those before; between, the newest trees are added where a pass reads the rows."""
    k = settings.classes
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return [], prior_scores({0: 1}, k)
    prior = prior_scores(counts, k)
    spark = rows.sparkSession
    state, path = _state(_start(rows, prior))
    done, recent = [], []
    for round_ in range(settings.rounds):
        partial, leaves = [], {}
        for level in range(settings.depth):
            counted = state.mapInArrow(_count_gradients(settings, recent, partial + list(leaves.values()), round_),
                                       "tree int, node int, hist binary")
            split = counted.groupBy("tree", "node").applyInArrow(_split_gradients(settings), BOOST_SPLIT).collect()
            for r in split:
                tree, node, total, left = r["tree"], r["node"], list(r["total"]), list(r["left"])
                known = leaves.pop((tree, node), None)
                row = (tree, node, r["feature"], r["bin"], total)
                if r["feature"] < 0:
                    leaves[tree, node] = known or row
                    continue
                partial.append(row)
                for side, sums in enumerate((left, [t - l for t, l in zip(total, left)])):
                    leaves[tree, 2 * node + side] = (tree, 2 * node + side, -1, -1, sums)
        new = [(*r, 0.0) for r in partial]
        new += [(*r, leaf_value(float(r[4][0]), float(r[4][1]), k, settings.step)) for r in leaves.values()]
        recent += new
        if (round_ + 1) % STATE_ROUNDS == 0 and round_ + 1 < settings.rounds:
            state, newer = _state(state.mapInArrow(_scored_state(settings, recent), STATE))
            delete_folder(spark, path)
            path, done, recent = newer, done + recent, []
    delete_folder(spark, path)
    return done + recent, prior


def boosting_scores(rows: DataFrame, nodes: list[tuple], prior: Sequence[float], settings: BoostSettings,
                    keep: Sequence[str] = ("id", "label")) -> DataFrame:
    """``keep`` and ``prediction``: the class with the highest score, ties to the smaller class."""
    def run(batches):
        trees, values = _with_values(nodes)
        for batch in batches:
            bins = _matrix(batch.column(len(keep)), np.uint8, settings.n_features)
            raw = add_trees(np.tile(np.array(prior), (len(bins), 1)), bins, trees, values, settings.classes)
            best = pa.array(raw.argmax(axis=1).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], best], names=[*keep, "prediction"])

    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField("prediction", T.DoubleType())])
    return rows.select(*keep, "bins").mapInArrow(run, schema)


# executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
