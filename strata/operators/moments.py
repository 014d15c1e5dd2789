"""Means, centred products and counts of all pairs of columns as one mergeable state.

One pass: a task keeps, for every pair of columns and over the rows where both are known, the row
count, both means, both centred sums of squares and the centred sum of products. States of
batches and tasks are merged by the pairwise update of means (no sum of squares of large values,
so no cancellation), in two levels, so that no task merges the states of all tasks. Correlations,
standardisation and the ranking by correlation read this one state.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

MERGE_GROUPS = 64  # states are first merged in so many groups, then these


class Moments:
    """State over ``k`` columns; ``own[i, j]`` belongs to column i over the rows where i and j are known."""

    def __init__(self, n, mean, square, product):
        self.n, self.mean, self.square, self.product = n, mean, square, product

    @classmethod
    def of(cls, x: np.ndarray) -> "Moments":
        known = ~np.isnan(x)
        m, filled = known.astype(np.float64), np.where(known, x, 0.0)
        n = m.T @ m
        # about a centre that lies inside the batch, so the sums below do not cancel
        centre = filled.sum(axis=0) / np.maximum(m.sum(axis=0), 1)
        y = np.where(known, x - centre, 0.0)
        safe = np.maximum(n, 1)
        shift = (y.T @ m) / safe
        square = (y * y).T @ m - safe * shift * shift
        return cls(n, centre[:, None] + shift, np.maximum(square, 0.0), y.T @ y - safe * shift * shift.T)

    def merge(self, other: "Moments") -> "Moments":
        n = self.n + other.n
        safe = np.maximum(n, 1)
        gap = other.mean - self.mean
        weight = self.n * other.n / safe
        return Moments(n, self.mean + gap * (other.n / safe), self.square + other.square + gap * gap * weight,
                       self.product + other.product + gap * gap.T * weight)

    def to_bytes(self) -> bytes:
        return np.stack([self.n, self.mean, self.square, self.product]).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, k: int) -> "Moments":
        return cls(*np.frombuffer(data, dtype=np.float64).reshape(4, k, k))


def _merged(states):
    out = None
    for s in states:
        out = s if out is None else out.merge(s)
    return out


def _states(k: int):
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns[1:]])
                here = Moments.of(x)
                total = here if total is None else total.merge(here)
                place = batch.column(0)[0].as_py()
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([place % MERGE_GROUPS], pa.int32()), pa.array([total.to_bytes()], pa.binary())],
                                             names=["g", "state"])
    return run


def _merge_group(k: int):
    def run(table: pa.Table) -> pa.Table:
        total = _merged(Moments.from_bytes(s.as_py(), k) for s in table.column("state"))
        return pa.table({"g": table.column("g").slice(0, 1), "state": pa.array([total.to_bytes()], pa.binary())})
    return run


def column_moments(df: DataFrame, columns: Sequence[str]) -> Moments | None:
    """The state of ``columns`` over all rows (NULL and NaN are missing), None without rows. The driver
    gets at most MERGE_GROUPS states of columns^2 x 32 bytes."""
    k = len(columns)
    rows = df.select(F.spark_partition_id().alias("p"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    states = rows.mapInArrow(_states(k), "g int, state binary").groupBy("g").applyInArrow(_merge_group(k), "g int, state binary")
    return _merged(Moments.from_bytes(bytes(r["state"]), k) for r in states.orderBy("g").collect())


def scaler(m: Moments) -> tuple[np.ndarray, np.ndarray]:
    """Means and population standard deviations, column by column."""
    n = np.maximum(np.diag(m.n), 1)
    return np.diag(m.mean).copy(), np.sqrt(np.diag(m.square) / n)


def correlation(m: Moments) -> np.ndarray:
    """Correlations over the rows where both columns are known; NaN where a column does not vary."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return m.product / np.sqrt(m.square * m.square.T)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
