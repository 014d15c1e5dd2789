"""Row-wise scores, flags and standardisation as native column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def row_sum(cols: Sequence, missing: str = "propagate") -> Column:
    """Sum across columns. ``propagate``: any NULL makes the sum NULL (SQL ``+`` chain);
    ``skip``: NULLs count as 0 (pandas ``sum(axis=1)``)."""
    parts = [_c(c) for c in cols]
    if missing == "skip":
        parts = [F.coalesce(p, F.lit(0)) for p in parts]
    elif missing != "propagate":
        raise ValueError("missing must be 'propagate' or 'skip'")
    return reduce(add, parts)


def flag(cond: Column) -> Column:
    """0/1 integer flag; a NULL comparison gives 0."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def weighted_sum(weights: Mapping[str, float]) -> Column:
    return reduce(add, [_c(c) * F.lit(float(w)) for c, w in weights.items()])


def guarded_ratio(num, den, eps: float) -> Column:
    """``num / (den + eps)``."""
    return _c(num) / (_c(den) + F.lit(eps))


def abs_diff(a, b) -> Column:
    return F.abs(_c(a) - _c(b))


def zscore(x, mean, sd) -> Column:
    """``(x - mean) / NULLIF(sd, 0)``: a zero or missing spread gives NULL."""
    return (_c(x) - _c(mean)) / F.nullif(_c(sd), F.lit(0.0))


def outlier_label(z: Column, k: float = 2.0, outlier: str = "Outlier", normal: str = "Normal") -> Column:
    """``|z| > k`` is an outlier; NULL z is normal."""
    return F.when(F.abs(z) > F.lit(k), F.lit(outlier)).otherwise(F.lit(normal))


def pct(num, den, digits: int | None = 1) -> Column:
    """``100 * num / den`` as double, rounded half away from zero; den 0 gives NULL."""
    v = F.lit(100.0) * _c(num) / F.nullif(_c(den).cast("double"), F.lit(0.0))
    return v if digits is None else F.round(v, digits)
