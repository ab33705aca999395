"""Survival function of the chi-square distribution, as a Column expression.

It is the regularised upper incomplete gamma function of half the degrees of freedom
and half the statistic: by its power series below the mean, and by its continued
fraction above, each a fold over as many steps as the size of the numbers asks for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands in for a zero in a denominator.
_TINY = 1e-300
#: From here on the asymptotic series of the logarithm of gamma is exact to a double.
_FAR = 12


def log_gamma(a: Column) -> Column:
    """Natural logarithm of the gamma function, for positive numbers: Stirling's series
    at ``a + 12``, stepped back to ``a``."""
    z = a + F.lit(float(_FAR))
    inverse = F.lit(1.0) / z
    square = inverse * inverse
    # Coefficients of the series: Bernoulli numbers B(2k) over 2k (2k - 1).
    series = inverse * (F.lit(1 / 12) + square * (F.lit(-1 / 360) + square * (
        F.lit(1 / 1260) + square * (F.lit(-1 / 1680) + square * F.lit(1 / 1188)))))
    above = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series
    return above - sum((F.ln(a + float(k)) for k in range(1, _FAR)), F.ln(a))


def _steps(a: Column, factor: float, least: int) -> Column:
    return F.sequence(F.lit(1), (F.lit(factor) * F.sqrt(a) + least).cast("int"))


def _guarded(value: Column) -> Column:
    return F.when(F.abs(value) < _TINY, F.lit(_TINY)).otherwise(value)


def _series(a: Column, x: Column) -> Column:
    """Sum of x**n / (a (a + 1) ... (a + n))."""
    first = F.lit(1.0) / a
    start = F.struct(first.alias("term"), first.alias("sum"))

    def step(s: Column, n: Column) -> Column:
        term = s["term"] * x / (a + n)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    return F.aggregate(_steps(a, 12.0, 60), start, step, lambda s: s["sum"])


def _fraction(a: Column, x: Column) -> Column:
    """Continued fraction of the upper function, from the front (Lentz's method)."""
    b = x + 1.0 - a
    d = F.lit(1.0) / _guarded(b)
    start = F.struct(b.alias("b"), F.lit(1 / _TINY).alias("c"), d.alias("d"), d.alias("h"))

    def step(s: Column, i: Column) -> Column:
        numerator = -i * (i - a)
        b = s["b"] + 2.0
        d = F.lit(1.0) / _guarded(numerator * s["d"] + b)
        c = _guarded(b + numerator / s["c"])
        return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    return F.aggregate(_steps(a, 30.0, 120), start, step, lambda s: s["h"])


def chi2_sf(statistic: Column, dof: Column) -> Column:
    """P(X >= statistic). One without degrees of freedom, or for a statistic that is not
    positive; null for null or not-a-number."""
    a, x = dof.cast("double") / 2.0, statistic.cast("double") / 2.0
    scale = F.exp(a * F.ln(x) - x - log_gamma(a))
    tail = F.when(x < a + 1.0, F.lit(1.0) - scale * _series(a, x)).otherwise(scale * _fraction(a, x))
    return (
        F.when(a.isNull() | x.isNull() | F.isnan(x), F.lit(None).cast("double"))
        .when((a <= 0) | (x <= 0), F.lit(1.0))
        .when(x > 1e300, F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))
    )
