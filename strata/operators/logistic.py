"""Multinomial logistic regression by Newton steps over one aggregated pass each.

Minimises the log loss summed over rows plus half the squared weights over C (intercepts are
free), on standardised features. A pass adds up loss, gradient and Hessian of all classes in every
task; the sums meet by position in a grouped sum. The driver solves the system of
classes x (features + 1) unknowns, whatever the number of rows, and stops when the largest gradient
component, evaluated at the returned coefficients, is below the tolerance.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from strata.operators.moments import column_moments, scaler

STEPS = 50          # Newton steps at most
TOLERANCE = 1e-7    # of the largest gradient component


class Logistic:
    """Coefficients (classes x features + 1, intercept last) on standardised features."""

    def __init__(self, features: Sequence[str], mean, sd, weights, gradient):
        self.features, self.mean, self.sd, self.weights, self.gradient = list(features), mean, sd, weights, gradient


def _design(batch, k: int, mean, sd) -> np.ndarray:
    x = np.column_stack([batch.column(batch.num_columns - k + i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(k)])
    return np.column_stack([(x - mean) / sd, np.ones(len(x))])


def _shares(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _pass(weights: np.ndarray, mean, sd):
    """Per task (place, value): the loss, then the gradient, then the Hessian, flattened."""
    classes, width = weights.shape

    def run(batches):
        loss, grad, hess = 0.0, np.zeros_like(weights), np.zeros((classes, width, classes, width))
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = _design(batch, width - 1, mean, sd)
            p = _shares(x @ weights.T)
            loss -= float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum())
            hot = np.zeros_like(p)
            hot[np.arange(len(y)), y] = 1.0
            grad += (p - hot).T @ x
            for a in range(classes):
                for b in range(a, classes):
                    w = p[:, a] * ((1.0 if a == b else 0.0) - p[:, b])
                    hess[a, :, b, :] += (x * w[:, None]).T @ x
        flat = np.concatenate([[loss], grad.ravel(), hess.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["i", "v"])
    return run


def _sums(rows: DataFrame, weights: np.ndarray, mean, sd):
    classes, width = weights.shape
    sums = rows.mapInArrow(_pass(weights, mean, sd), "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    flat = np.zeros(1 + weights.size + weights.size ** 2)
    for r in sums.collect():  # as many rows as unknowns, squared
        flat[r["i"]] = r["v"]
    hess = flat[1 + weights.size:].reshape(classes, width, classes, width)
    for a in range(classes):
        for b in range(a):
            hess[a, :, b, :] = hess[b, :, a, :].T
    return flat[0], flat[1:1 + weights.size].reshape(classes, width), hess.reshape(weights.size, weights.size)


def fit_logistic(rows: DataFrame, features: Sequence[str], classes: int, label: str = "label", c: float = 1.0,
                 steps: int = STEPS, tolerance: float = TOLERANCE) -> Logistic:
    """Fits on ``rows``; a feature that does not vary is centred only. A step that does not lower the
    loss is halved. ``gradient`` of the result is the penalised gradient at its coefficients."""
    moments = column_moments(rows, features)
    k = len(features)
    mean, sd = (np.zeros(k), np.ones(k)) if moments is None else scaler(moments)
    sd = np.where(sd > 0, sd, 1.0)
    source = rows.select(F.col(label).cast("int").alias("y"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    free = np.ones((classes, k + 1)) / c
    free[:, -1] = 0.0  # intercepts bear no penalty

    def evaluate(w):
        loss, grad, hess = _sums(source, w, mean, sd)
        return loss + 0.5 * float((free * w * w).sum()), grad + free * w, hess + np.diag(free.ravel())

    weights = np.zeros((classes, k + 1))
    loss, grad, hess = evaluate(weights)
    for _ in range(steps):
        if np.abs(grad).max() < tolerance:
            break
        # equal shifts of all intercepts change nothing: the least-norm step leaves them out
        step = np.linalg.lstsq(hess, grad.ravel(), rcond=1e-12)[0].reshape(weights.shape)
        size = 1.0
        while True:
            tried = evaluate(weights - size * step)
            if tried[0] <= loss * (1 + 1e-12) or size < 1e-4:
                break
            size /= 2
        weights = weights - size * step
        loss, grad, hess = tried
    return Logistic(features, mean, sd, weights, grad)


def logistic_scores(rows: DataFrame, model: Logistic, keep: Sequence[str] = ("id", "label")) -> DataFrame:
    """``keep`` and ``prediction``: the class with the highest score, ties to the smaller class."""
    k = len(model.features)

    def run(batches):
        for batch in batches:
            z = _design(batch, k, model.mean, model.sd) @ model.weights.T if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(z.argmax(axis=1).astype(np.float64))],
                                             names=[*keep, "prediction"])

    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField("prediction", T.DoubleType())])
    return rows.select(*keep, *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(model.features)]).mapInArrow(run, schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
