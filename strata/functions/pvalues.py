"""Upper tails of the chi-square and F distributions, as Spark expressions.

Both tails are integrals of a smooth positive function over [0, inf) (DLMF 8.2.2 and 8.17.1
after a change of variable):

    chi-square:  Q(a, x) = x^(a-1) e^-x / Gamma(a) * I,   I = int_0^inf e^-s (1 + s/x)^(a-1) ds,
                 a = dof / 2, x = statistic / 2 (beyond 2,500 degrees of freedom see _wide_tail)
    F:           I_y(a, b) = y^a / (a B(a, b)) * J,       J = int_0^inf e^-s (1 - y e^(-s/a))^(b-1) ds,
                 a = d2 / 2, b = d1 / 2, y = d2 / (d2 + d1 f)

With s = e^w the integrand is analytic and falls off fast on both sides, so the trapezoidal rule
over a fixed range of w converges geometrically. The gamma functions use Stirling's series
(DLMF 5.11.1) after a shift; the ratio Gamma(a + b) / Gamma(a) is taken from differences of the
series, so it keeps its digits for any number of rows. Everything is one expression per result
row; there is no iteration limit and no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

STEP = 0.02               # of w
LOW, HIGH = -45.0, 9.0    # e^-45 .. e^9: covers 2,500 degrees of freedom of the chi-square
WIDE_DOF = 2_500          # beyond, the chi-square tail is integrated around its peak
FAR = 38.0                # standard deviations beyond which a tail is 0 or 1 in doubles
SHIFT = 8                 # Stirling's series is used from here on


def _trapezoid(f) -> Column:
    """int_0^inf f(s) ds with s = e^w."""
    n = round((HIGH - LOW) / STEP)

    def term(acc: Column, i: Column) -> Column:
        s = F.exp(F.lit(LOW) + i * F.lit(STEP))
        return acc + s * f(s)

    return F.aggregate(F.sequence(F.lit(0), F.lit(n)), F.lit(0.0), term) * F.lit(STEP)


def _series(z: Column) -> Column:
    """Stirling's correction to (z - 1/2) ln z - z + ln(2 pi) / 2."""
    q = 1 / (z * z)
    return (F.lit(1 / 12) - q * (F.lit(1 / 360) - q * (F.lit(1 / 1260) - q * (F.lit(1 / 1680) - q * F.lit(1 / 1188))))) / z


def log_gamma(z: Column) -> Column:
    """ln Gamma(z) for z > 0."""
    up = z + SHIFT
    below = sum((F.log(z + i) for i in range(SHIFT)), F.lit(0.0))
    return (up - 0.5) * F.log(up) - up + F.lit(0.9189385332046727) + _series(up) - below


def log_gamma_ratio(a: Column, b: Column) -> Column:
    """ln (Gamma(a + b) / Gamma(a)), from differences: exact digits also where a is huge."""
    z = a + SHIFT
    below = sum((F.log1p(b / (a + i)) for i in range(SHIFT)), F.lit(0.0))
    return (z + b - 0.5) * F.log1p(b / z) + b * F.log(z) - b + _series(z + b) - _series(z) - below


def _excess(v: Column) -> Column:
    """e^v - 1 - v without loss of digits near 0."""
    series = v * v / 2 * (1 + v / 3 * (1 + v / 4 * (1 + v / 5 * (1 + v / 6 * (1 + v / 7)))))
    return F.when(F.abs(v) < 0.02, series).otherwise(F.expm1(v) - v)


def _wide_tail(a: Column, x: Column) -> Column:
    """Q(a, x) for large a: with t = a e^(y / sqrt a) the integrand of the gamma tail becomes
    e^(-a (e^v - 1 - v)) in v = y / sqrt a, close to a normal curve in y, whatever a is."""
    root = F.sqrt(a)
    y = root * F.log(x / a)
    area = _trapezoid(lambda s: F.exp(-a * _excess((y + s) / root)))
    return (F.when(y < -FAR, F.lit(1.0)).when(y > FAR, F.lit(0.0))
            .otherwise(F.exp(-_series(a)) / F.lit(2.5066282746310002) * area))


def chi2_pvalue(stat: Column, dof: Column) -> Column:
    """P(X > stat) for X ~ chi-square(dof), at any degrees of freedom; NULL for a NULL or NaN statistic
    or dof below 1."""
    a, x = dof.cast("double") / 2, stat.cast("double") / 2
    tail = F.exp((a - 1) * F.log(x) - x - log_gamma(a)) * _trapezoid(
        lambda s: F.exp(-s + (a - 1) * F.log1p(s / x)))
    tail = F.when(dof <= WIDE_DOF, tail).otherwise(_wide_tail(a, x))
    known = stat.isNotNull() & ~F.isnan(stat.cast("double")) & (dof > 0)
    return F.when(known, F.when(x <= 0, F.lit(1.0)).otherwise(F.least(tail, F.lit(1.0))))


def f_pvalue(stat: Column, d1: Column, d2: Column) -> Column:
    """P(X > stat) for X ~ F(d1, d2); NULL for a NULL or NaN statistic or degrees below 1."""
    f = stat.cast("double")
    a, b = d2.cast("double") / 2, d1.cast("double") / 2
    spread = F.log1p(d1 * f / d2)  # -ln y
    front = -a * spread - F.log(a) + log_gamma_ratio(a, b) - log_gamma(b)
    tail = F.exp(front) * _trapezoid(lambda s: F.exp(-s + (b - 1) * F.log(-F.expm1(-(spread + s / a)))))
    known = stat.isNotNull() & ~F.isnan(f) & (d1 > 0) & (d2 > 0)
    return F.when(known, F.when(f <= 0, F.lit(1.0)).otherwise(F.least(tail, F.lit(1.0))))
