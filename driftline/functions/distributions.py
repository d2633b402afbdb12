"""Tail probabilities and quantiles as column expressions.

Continued fractions and series are evaluated backwards by a fold over a sequence whose
length follows the size of the parameters, so they stay in the JVM and hold at any
number of degrees of freedom.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Arguments are raised this far by the recurrence before Stirling's series is used.
RAISED = 10
# Coefficients of 1/x, 1/x^3, ... of Stirling's series.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)
LEAST_TERMS = 60
NEWTON_ROUNDS = 12


def _correction(x: Column) -> Column:
    return sum((F.lit(c) / F.pow(x, F.lit(2.0 * k + 1)) for k, c in enumerate(STIRLING)), F.lit(0.0))


def ln_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of a positive argument."""
    y = x + RAISED
    below = F.ln(x)
    for k in range(1, RAISED):
        below = below + F.ln(x + k)
    return (y - 0.5) * F.ln(y) - y + math.log(2 * math.pi) / 2 + _correction(y) - below


def ln_gamma_rise(a: Column, b: Column) -> Column:
    """ln gamma(a + b) - ln gamma(a), without cancellation where ``a`` is large."""
    y = a + RAISED
    above = (y - 0.5) * F.log1p(b / y) + b * F.ln(y + b) - b + _correction(y + b) - _correction(y)
    for k in range(RAISED):
        above = above - F.log1p(b / (a + k))
    return above


def _terms(size: Column) -> Column:
    """Numbers from a sufficient count of terms down to 1."""
    count = (LEAST_TERMS + 8 * F.sqrt(size)).cast("double")
    return F.reverse(F.transform(F.sequence(F.lit(1), count.cast("int")), lambda k: k.cast("double")))


def _bound(make: Callable[..., Column], **values: Column) -> Column:
    """``make`` of the values, each evaluated once however often it is used."""
    known = F.array(F.struct(*[c.alias(n) for n, c in values.items()]))
    return F.transform(known, lambda v: make(**{n: v[n] for n in values}))[0]


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    def step(f: Column, k: Column) -> Column:
        m = F.floor(k / 2)
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return 1 + F.when(k % 2 == 0, even).otherwise(odd) / f

    return 1 / F.aggregate(_terms(F.greatest(a, b)), F.lit(1.0), step)


def f_tail(value: Column, d1: Column, d2: Column) -> Column:
    """P(F > value) for ``d1`` and ``d2`` degrees of freedom; NULL for NULL, NaN or none of them."""
    def tail(f: Column, a: Column, b: Column, odds: Column) -> Column:
        near = 1 / (1 + odds) < (a + 1) / (a + b + 2)
        # ln B(a, b), the larger parameter first.
        ln_beta = _bound(lambda large, small: ln_gamma(small) - ln_gamma_rise(large, small), large=F.greatest(a, b), small=F.least(a, b))
        front = F.exp(b * F.ln(odds) - (a + b) * F.log1p(odds) - ln_beta)
        fraction = _bound(
            _beta_fraction, a=F.when(near, a).otherwise(b), b=F.when(near, b).otherwise(a),
            x=F.when(near, 1.0).otherwise(odds) / (1 + odds))
        found = _bound(lambda p: F.when(near, p / a).otherwise(1 - p / b), p=front * fraction)
        return F.when(f <= 0, 1.0).when(f < math.inf, found).otherwise(0.0)

    f, one, two = (c.cast("double") for c in (value, d1, d2))
    known = (one > 0) & (two > 0) & f.isNotNull() & ~F.isnan(f)
    return F.when(known, _bound(tail, f=f, a=two / 2, b=one / 2, odds=one * f / two))


def t_tail(value: Column, df: Column) -> Column:
    """P(|T| > |value|) for ``df`` degrees of freedom."""
    return f_tail(value * value, F.lit(1.0), df)


def chi2_tail(value: Column, df: Column) -> Column:
    """P(X > value) for the chi-square distribution; NULL for NULL or NaN."""
    def tail(x: Column, a: Column) -> Column:
        front = a * F.ln(x) - x - ln_gamma(a)
        series = F.aggregate(_terms(F.greatest(a, x)), F.lit(1.0), lambda s, k: 1 + x / (a + k) * s)
        fraction = F.aggregate(_terms(a), F.lit(math.inf), lambda f, k: (x + 2 * k - 1 - a) - k * (k - a) / f)
        found = F.when(x < a + 1, 1 - F.exp(front) / a * series).otherwise(F.exp(front) / fraction)
        return F.when(x <= 0, 1.0).when(x < math.inf, found).otherwise(0.0)

    x, a = value.cast("double") / 2, df.cast("double") / 2
    known = (a > 0) & x.isNotNull() & ~F.isnan(x)
    return F.when(known, _bound(tail, x=x, a=a))


def t_quantile(outside: float, df: Column) -> Column:
    """The value that |T| exceeds with probability ``outside``; NULL without degrees of freedom.

    Newton's steps on the logarithms of value and tail, which bend little even for one
    degree of freedom.
    """
    def found(nu: Column, front: Column) -> Column:
        def step(t: Column, _: Column) -> Column:
            def moved(tail: Column) -> Column:
                density = F.exp(front - (nu + 1) / 2 * F.log1p(t * t / nu))
                move = (F.ln(tail) - math.log(outside)) * tail / (2 * t * density)
                return t * F.exp(F.greatest(F.least(move, F.lit(2.0)), F.lit(-2.0)))

            return _bound(moved, tail=t_tail(t, nu))

        return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_ROUNDS)), F.lit(1.0), step)

    nu = df.cast("double")
    return F.when(nu > 0, _bound(found, nu=nu, front=ln_gamma_rise(nu / 2, F.lit(0.5)) - F.ln(nu * math.pi) / 2))
