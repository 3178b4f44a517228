"""Tail probabilities Spark SQL lacks, for rows that are already reduced.

The UDFs see one row per column pair, never table rows. Nothing cancels and nothing is cut
off: products of large powers are taken by log1p(u) - u around their largest value, and
continued fractions go on until they have converged.
"""

import math
import sys
from itertools import count

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TINY = 1e-300
EPSILON = 1e-15
LARGE = 1e5


def _continued_fraction(terms, first):
    """Modified Lentz evaluation of first + a1/(b1 + a2/(b2 + ...))."""
    value = first if first != 0 else TINY
    c, d = value, 0.0
    for a, b in terms:
        d = b + a * d
        d = 1.0 / (d if d != 0 else TINY)
        c = b + a / c
        c = c if c != 0 else TINY
        value *= c * d
        if abs(c * d - 1.0) < EPSILON:
            return value
    return value


def _beta_terms(a, b, x):
    yield 1.0, 1.0
    for m in count():
        if m > 0:
            yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
        yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0


def _log1p_less(u: float) -> float:
    """log(1 + u) - u."""
    if abs(u) > 0.01:
        return math.log1p(u) - u
    total, power = 0.0, -u * u
    for k in range(2, 12):
        total += power / k
        power *= -u
    return total


def _stirling_rest(a: float) -> float:
    """log(gamma(a)) less (a - 1/2) log(a) - a + log(2 pi) / 2."""
    if a < 10.0:
        return math.lgamma(a) - (a - 0.5) * math.log(a) + a - 0.5 * math.log(2 * math.pi)
    s = 1.0 / (a * a)
    return (1 / 12 - s * (1 / 360 - s * (1 / 1260 - s / 1680))) / a


def _log_beta_front(a: float, b: float, x: float, y: float) -> float:
    """log(x^a y^b / B(a, b)) where x + y = 1."""
    at_peak = 0.5 * (math.log(a) + math.log(b) - math.log(a + b) - math.log(2 * math.pi))
    rest = _stirling_rest(a + b) - _stirling_rest(a) - _stirling_rest(b)
    off = x * b - a * y
    return a * _log1p_less(off / a) + b * _log1p_less(-off / b) + at_peak + rest


def beta_tails(a: float, b: float, x: float, y: float) -> tuple[float, float]:
    """I_x(a, b) and 1 - I_x(a, b), the regularised incomplete beta; y is 1 - x, given
    because it may be known to more digits."""
    if x <= 0.0:
        return 0.0, 1.0
    if y <= 0.0:
        return 1.0, 0.0
    if b > LARGE * max(a, 1.0):
        high, low = beta_tails(b, a, y, x)
        return low, high
    if a > LARGE * max(b, 1.0):
        # -log of such a variable follows a gamma distribution, up to terms of (b / a)^2;
        # the fraction below would creep towards its value in steps too small to notice.
        upper = upper_gamma(b, -(a + (b - 1.0) / 2.0) * math.log1p(-y))
        return upper, 1.0 - upper
    if x > (a + 1.0) / (a + b + 2.0):
        high, low = beta_tails(b, a, y, x)
        return low, high
    tail = math.exp(_log_beta_front(a, b, x, y)) / a * _continued_fraction(_beta_terms(a, b, x), 0.0)
    return tail, 1.0 - tail


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    return beta_tails(a, b, x, 1.0 - x)[0]


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(
        a * _log1p_less((x - a) / a) + 0.5 * math.log(a / (2 * math.pi)) - _stirling_rest(a)
    )
    if x < a + 1.0:
        term = total = 1.0 / a
        step = a
        while term > EPSILON * total:
            step += 1.0
            term *= x / step
            total += term
        return max(0.0, 1.0 - front * total)
    terms = ((1.0 if k == 0 else k * (a - k), x + 2 * k + 1 - a) for k in count())
    return front * _continued_fraction(terms, 0.0)


def pearson_p_value(r: float, n: float) -> float | None:
    if n < 2:
        return None
    if n == 2:
        return 1.0
    square = min(1.0, r * r)
    return beta_tails(0.5, n / 2.0 - 1.0, square, 1.0 - square)[1]


def anova_p_value(f: float, groups: float, n: float) -> float | None:
    between, within = groups - 1.0, n - groups
    if between <= 0 or within <= 0:
        return None
    if math.isinf(f):
        return 0.0
    whole = within + between * f
    return beta_tails(within / 2.0, between / 2.0, within / whole, between * f / whole)[0]


def chi_square_p_value(x: float, dof: float) -> float | None:
    if dof <= 0:
        return None
    return upper_gamma(dof / 2.0, x / 2.0)


def _over_rows(function, *columns):
    values = [
        None if any(pd.isna(v) for v in row) else function(*row) for row in zip(*columns)
    ]
    return pd.Series(values, dtype="float64")


@F.pandas_udf(T.DoubleType())
def pearson_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return _over_rows(pearson_p_value, r, n)


@F.pandas_udf(T.DoubleType())
def anova_p(f: pd.Series, groups: pd.Series, n: pd.Series) -> pd.Series:
    return _over_rows(anova_p_value, f, groups, n)


@F.pandas_udf(T.DoubleType())
def chi_square_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _over_rows(chi_square_p_value, x, dof)
