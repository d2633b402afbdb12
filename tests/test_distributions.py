"""Tail probabilities against closed forms and numerical integrals."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import distributions as dist


def t_outside(value, nu):
    """P(|T| > value) by integrating over the angle, in the tail or in the middle."""
    angle = math.atan(abs(value) / math.sqrt(nu))
    nodes, weights = np.polynomial.legendre.leggauss(200)
    scale = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(math.pi)
    top = min(math.pi / 2, angle + 40 / math.sqrt(nu))
    at = angle + (top - angle) * (nodes + 1) / 2
    return 2 * scale * (weights * np.exp((nu - 1) * np.log(np.cos(at)))).sum() * (top - angle) / 2


def chi2_outside(value, k):
    """P(X > value): finite sum for even k, with the normal tail for odd k."""
    z = value / 2
    if k % 2 == 0:
        return math.exp(-z) * sum(z**j / math.factorial(j) for j in range(k // 2))
    total = math.erfc(math.sqrt(z))
    for j in range(k // 2):
        total += math.exp((j + 0.5) * math.log(z) - z - math.lgamma(j + 1.5))
    return total


def f_outside(value, d1, d2):
    """P(F > value) for even d1: a finite sum."""
    x = d2 / (d2 + d1 * value)
    return sum(math.exp(math.lgamma(d2 / 2 + j) - math.lgamma(d2 / 2) - math.lgamma(j + 1) + d2 / 2 * math.log(x)) * (1 - x) ** j for j in range(d1 // 2))


def evaluated(spark, rows, schema, column):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").repartition(3)
    return [r[1] for r in sorted(frame.select("i", column.alias("p")).collect())]


def test_t_tail(spark):
    rows = [(t, float(nu)) for nu in (1, 2, 3, 7, 30, 150, 5000, 60000) for t in (1e-4, 0.1, 0.7, 1.0, 1.9, 3.3, 6.0)]
    found = evaluated(spark, rows, "t double, nu double", dist.t_tail(F.col("t"), F.col("nu")))
    assert found == pytest.approx([t_outside(*r) for r in rows], rel=1e-8, abs=1e-10)
    large = evaluated(spark, [(1.5, 1e9), (-4.0, 1e9)], "t double, nu double", dist.t_tail(F.col("t"), F.col("nu")))
    assert large == pytest.approx([math.erfc(1.5 / math.sqrt(2)), math.erfc(4 / math.sqrt(2))], rel=1e-6)


def test_f_tail(spark):
    rows = [(f, d1, d2) for d1 in (2, 4, 10, 60) for d2 in (1, 3, 12, 99, 9995) for f in (0.01, 0.5, 1.0, 1.3, 2.5, 9.0)]
    found = evaluated(spark, rows, "f double, a int, b int", dist.f_tail(F.col("f"), F.col("a"), F.col("b")))
    assert found == pytest.approx([f_outside(*r) for r in rows], rel=1e-9, abs=1e-11)


def test_chi2_tail(spark):
    rows = [(x, k) for k in (1, 2, 3, 4, 9, 40, 200) for x in (1e-3, 0.3, 1.0, 3.0, 11.0, 60.0, 180.0, 260.0)]
    found = evaluated(spark, rows, "x double, k int", dist.chi2_tail(F.col("x"), F.col("k")))
    assert found == pytest.approx([chi2_outside(*r) for r in rows], rel=1e-9, abs=1e-12)


def test_values_without_a_tail(spark):
    rows = [(None, 3.0), (1.0, None), (1.0, 0.0), (float("nan"), 3.0), (0.0, 3.0), (float("inf"), 3.0), (-1.0, 3.0)]
    for column in (dist.f_tail(F.col("x"), F.lit(2), F.col("k")), dist.chi2_tail(F.col("x"), F.col("k"))):
        assert evaluated(spark, rows, "x double, k double", column) == [None, None, None, None, 1.0, 0.0, 1.0]
    assert evaluated(spark, [(0.0,), (None,)], "k double", dist.t_quantile(0.05, F.col("k"))) == [None, None]


@pytest.mark.parametrize("outside", [0.5, 0.05, 0.001])
def test_t_quantile_undoes_the_tail(spark, outside):
    rows = [(float(nu),) for nu in (1, 2, 3, 10, 65, 1000, 60000)]
    found = evaluated(spark, rows, "nu double", dist.t_quantile(outside, F.col("nu")))
    assert [t_outside(t, nu) for t, (nu,) in zip(found, rows, strict=True)] == pytest.approx([outside] * len(rows), rel=1e-8)
    if outside == 0.05:
        assert found[0] == pytest.approx(12.706204736432095, rel=1e-9) and found[3] == pytest.approx(2.2281388519649385, rel=1e-9)


def test_ln_gamma(spark):
    rows = [(x,) for x in (1e-3, 0.5, 1.0, 2.5, 17.0, 1e4, 1e8)]
    found = evaluated(spark, rows, "x double", dist.ln_gamma(F.col("x")))
    assert found == pytest.approx([math.lgamma(x) for (x,) in rows], rel=1e-13, abs=1e-12)
