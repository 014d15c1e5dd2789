"""Code-to-label and range-to-label column expressions (all native, no UDF)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from strata.sources import schema as S


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def map_codes(col, mapping: Mapping, default=None) -> Column:
    """Simple CASE: each key maps to its value; no match gives ``default`` (NULL if None)."""
    col = _c(col)
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == F.lit(k), F.lit(v)) if expr is None else expr.when(col == F.lit(k), F.lit(v))
    return expr if default is None else expr.otherwise(F.lit(default))


def two_way(col, code, if_equal: str, otherwise: str) -> Column:
    """``CASE WHEN col = code THEN a ELSE b END``: NULL and every other code take ``b``."""
    return F.when(_c(col) == F.lit(code), F.lit(if_equal)).otherwise(F.lit(otherwise))


def range_label(col, ranges: Sequence[tuple], default=None) -> Column:
    """Inclusive ranges ``(lo, hi, label)`` tried in order; outside all gives ``default``.

    With ``default=None`` a gap (e.g. age 4.5) or a NULL gives NULL, as a CASE without
    ELSE does; with a default the value falls through to it.
    """
    col = _c(col)
    expr = None
    for lo, hi, label in ranges:
        cond = col.between(F.lit(lo), F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr if default is None else expr.otherwise(F.lit(default))


def threshold_label(col, bounds: Sequence[tuple], rest, inclusive: bool = False) -> Column:
    """Ordered buckets ``(bound, label)``: first with ``col < bound`` (``<=`` if inclusive).

    A value that passes no test (including NULL) takes ``rest``, like CASE ... ELSE.
    """
    col = _c(col)
    expr = None
    for bound, label in bounds:
        cond = col <= F.lit(bound) if inclusive else col < F.lit(bound)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(rest))


def threshold_order(col, bounds: Sequence[tuple], inclusive: bool = False) -> Column:
    """Sort key 1..k+1 matching :func:`threshold_label`."""
    col = _c(col)
    expr = None
    for i, (bound, _) in enumerate(bounds, start=1):
        cond = col <= F.lit(bound) if inclusive else col < F.lit(bound)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr.otherwise(F.lit(len(bounds) + 1))


def order_key(col, ordered_labels: Sequence[str], rest: int | None = None) -> Column:
    """Position (1-based) of a label in an ordered list; unlisted -> ``rest`` (NULL if None)."""
    return map_codes(col, {lab: i for i, lab in enumerate(ordered_labels, start=1)}, rest)


# --- the workload's own label columns ----------------------------------------

def diagnosis_label(col="Diagnosis_Class") -> Column:
    return map_codes(col, S.DIAGNOSIS_LABELS)


def gender_sql(col="Gender") -> Column:
    """SQL rule: code 1 is Male, everything else (2, 9, NULL) is Female."""
    return two_way(col, 1, "Male", "Female")


def gender_label(col="Gender") -> Column:
    """Notebook rule: dictionary lookup, unmapped codes are NULL."""
    return map_codes(col, S.GENDER_LABELS)


def life_stage(col="Age", variant: str = "sql") -> Column:
    if variant == "sql":
        return range_label(col, S.LIFE_STAGES)
    # notebook: anything not in the first three ranges, NULL included, is Adult
    return range_label(col, S.LIFE_STAGES_SHORT, S.LIFE_STAGE_SHORT_ELSE)


def age_band(col="Age", variant: str = "sql") -> Column:
    return range_label(col, S.AGE_BANDS, None if variant == "sql" else S.AGE_BAND_ELSE)


def sleep_bucket(col="Sleep_Hours") -> Column:
    return threshold_label(col, S.SLEEP_BUCKETS, S.SLEEP_BUCKET_ELSE)


def sleep_order(col="Sleep_Hours") -> Column:
    return threshold_order(col, S.SLEEP_BUCKETS)


def screen_bucket(col="Daily_Phone_Usage_Hours") -> Column:
    return threshold_label(col, S.SCREEN_BUCKETS, S.SCREEN_BUCKET_ELSE)


def severity_class(col="Total_Severity") -> Column:
    return threshold_label(col, S.SEVERITY_CLASSES, S.SEVERITY_CLASS_ELSE, inclusive=True)


def risk_rule(sleep="Sleep_Risk_Flag", screen="High_Screen_Flag", anxiety="Anxiety_Risk_Flag") -> Column:
    """Rule-based category from three 0/1 flags; anxiety alone stays Low."""
    s, h, a = _c(sleep) == 1, _c(screen) == 1, _c(anxiety) == 1
    crit, high, mod, low = S.RISK_RULE_ORDER
    return (F.when(s & h & a, crit).when(s & h, high).when(s | h, mod).otherwise(low))


def family_history_code(col="Family_History") -> Column:
    return map_codes(col, S.FAMILY_HISTORY_CODES)
