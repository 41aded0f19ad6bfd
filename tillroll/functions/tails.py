"""Tail probabilities for the one-row results of the hypothesis tests.

Spark has neither ``erfc`` nor the incomplete gamma and beta functions. They are
needed once per test, on a frame of one row, after executors have reduced the
samples to a few sums.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Workers get these few functions with the task; the package need not be installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A little over the spacing of doubles at 1.
_EPS = 4e-16
# From so many degrees of freedom on, a t value is turned into a normal one.
_LARGE_DOF = 10_000
_TINY = 1e-300


def normal_sf(z: float) -> float:
    """P(Z > z); ``erfc`` keeps full precision far out in the tail."""
    return 0.5 * math.erfc(z / math.sqrt(2.0))


# From so many standard deviations on, a normal tail is worked out in logarithms.
_FAR = 20.0


def log_normal_sf(z: float) -> float:
    """ln P(Z > z), also where the probability itself is below the least double.

    Far out by the asymptotic series 1 - 1/z^2 + 3/z^4 - 15/z^6 ... of the tail over its
    leading term; from ``_FAR`` on its terms fall below a double's precision.
    """
    if z < _FAR:
        return math.log(normal_sf(z))
    total = term = 1.0
    for k in range(1, 60, 2):
        term *= -k / (z * z)
        total += term
        if abs(term) < _EPS:
            break
    return -z * z / 2 - math.log(z * math.sqrt(2 * math.pi)) + math.log(total)


def _continued_fraction(terms) -> float:
    """Value of b0 + a1/(b1 + a2/(b2 + ...)) by the modified Lentz recurrence.

    ``terms`` yields (a, b), starting with (anything, b0).
    """
    terms = iter(terms)
    _, b = next(terms)
    value = b or _TINY
    c, d = value, 0.0
    for a, b in terms:
        d = 1.0 / ((b + a * d) or _TINY)
        c = (b + a / c) or _TINY
        value *= c * d
        if abs(c * d - 1.0) < _EPS:
            return value
    raise ArithmeticError("a continued fraction did not converge")


def chi2_sf(x: float, dof: float) -> float:
    """P(X > x) for a chi-square variable: the regularised upper incomplete gamma."""
    if dof <= 0:
        return 1.0
    s, y = dof / 2.0, x / 2.0
    if y <= 0:
        return 1.0
    if y < s + 1:
        scale = math.exp(s * math.log(y) - y - math.lgamma(s))
        term = total = 1.0 / s
        k = s
        while term > total * _EPS:
            k += 1
            term *= y / k
            total += term
        return 1.0 - scale * total
    return math.exp(log_chi2_sf(x, dof))


def log_chi2_sf(x: float, dof: float) -> float:
    """ln P(X > x); beyond the mean by a continued fraction, which nothing underflows."""
    s, y = dof / 2.0, x / 2.0
    if dof <= 0 or y < s + 1:
        return math.log(chi2_sf(x, dof))

    def terms():
        yield 0.0, y + 1 - s
        for i in range(1, 100_000):
            yield i * (s - i), y + 2 * i + 1 - s

    return s * math.log(y) - y - math.lgamma(s) - math.log(_continued_fraction(terms()))


def _beta_regularised(x: float, a: float, b: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_regularised(1 - x, b, a)
    return math.exp(_log_beta_regularised(x, a, b))


def _log_beta_regularised(x: float, a: float, b: float) -> float:
    """ln of the regularised incomplete beta function below its mean."""
    front = (
        math.lgamma(a + b)
        - math.lgamma(a)
        - math.lgamma(b)
        + a * math.log(x)
        + b * math.log1p(-x)
    )

    def terms():
        yield 0.0, 1.0
        for m in range(100_000):
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
            k = m + 1
            yield k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), 1.0

    return front - math.log(a) - math.log(_continued_fraction(terms()))


def _t_as_normal(t: float, dof: float) -> float:
    """The normal deviate with the tail of ``t``, by Hill's expansion in 1 / dof.

    Its first left-out term is far below a double's precision from _LARGE_DOF on. The
    incomplete beta function would subtract log-gammas of about dof there.
    """
    a = dof - 0.5
    b = 48.0 * a * a
    z = math.sqrt(a * math.log1p(t * t / dof))
    first = (z**3 + 3 * z) / b
    second = (4 * z**7 + 33 * z**5 + 240 * z**3 + 855 * z) / (10 * b * (b + 0.8 * z**4 + 100))
    return z + first - second


def student_t_two_sided(t: float, dof: float) -> float:
    if dof >= _LARGE_DOF:
        return 2 * normal_sf(_t_as_normal(abs(t), dof))
    return _beta_regularised(dof / (dof + t * t), dof / 2.0, 0.5)


def log_student_t_two_sided(t: float, dof: float) -> float:
    """ln of the two-sided tail of ``t``."""
    if dof >= _LARGE_DOF:
        return math.log(2) + log_normal_sf(_t_as_normal(abs(t), dof))
    x, a, b = dof / (dof + t * t), dof / 2.0, 0.5
    if x >= 1 or x > (a + 1) / (a + b + 2):
        return math.log(student_t_two_sided(t, dof))
    return _log_beta_regularised(x, a, b)


def u_ways(n1: int, n2: int) -> list[int]:
    """In how many of the orders of two samples without ties U is 0, 1, ... n1 * n2.

    The generating function is the product over i up to the smaller size n of
    (1 - x**(m + i)) / (1 - x**i), worked out in place on exact integers.
    """
    n, m = sorted((n1, n2))
    ways = [1] + [0] * (n * m)
    for i in range(1, n + 1):
        for u in range(n * m, m + i - 1, -1):
            ways[u] -= ways[u - m - i]
        for u in range(i, n * m + 1):
            ways[u] += ways[u - i]
    return ways


def mann_whitney_exact(u: float, n1: float, n2: float) -> float:
    """P(U >= u) when both samples come from one distribution."""
    ways = u_ways(int(n1), int(n2))
    return sum(ways[max(0, math.ceil(u)) :]) / sum(ways)


def _vectorised(fn):
    def apply(*columns: pd.Series) -> pd.Series:
        return pd.Series(
            [
                None if any(pd.isna(v) for v in row) else fn(*row)
                for row in zip(*columns)
            ],
            dtype="float64",
        )

    return apply


@F.pandas_udf(DoubleType())
def normal_sf_udf(z: pd.Series) -> pd.Series:
    return _vectorised(normal_sf)(z)


@F.pandas_udf(DoubleType())
def chi2_sf_udf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _vectorised(chi2_sf)(x, dof)


@F.pandas_udf(DoubleType())
def student_t_two_sided_udf(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _vectorised(student_t_two_sided)(t, dof)


@F.pandas_udf(DoubleType())
def mann_whitney_exact_udf(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    return _vectorised(mann_whitney_exact)(u, n1, n2)


def _log10_udf(log_tail):
    """ln as log10; a p of 0 or less than a double can say keeps its digits there."""

    @F.pandas_udf(DoubleType())
    def apply(statistic: pd.Series, dof: pd.Series) -> pd.Series:
        return _vectorised(lambda x, k: log_tail(x, k) / math.log(10))(statistic, dof)

    return apply


log10_normal_udf = _log10_udf(lambda z, _: log_normal_sf(z))
log10_chi2_udf = _log10_udf(log_chi2_sf)
log10_student_udf = _log10_udf(log_student_t_two_sided)
