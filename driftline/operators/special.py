"""Derivatives of the logarithm of the gamma function, for the few numbers a fit handles at once."""

from __future__ import annotations

import math

# Below this an argument is raised by the recurrence before the asymptotic series is used.
ASYMPTOTIC_FROM = 10
# Bernoulli numbers B2, B4, ... of the series.
BERNOULLI = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730)


def digamma(x: float) -> float:
    total = 0.0
    while x < ASYMPTOTIC_FROM:
        total -= 1 / x
        x += 1
    series = sum(b / (2 * k * x ** (2 * k)) for k, b in enumerate(BERNOULLI, start=1))
    return total + math.log(x) - 1 / (2 * x) - series


def trigamma(x: float) -> float:
    total = 0.0
    while x < ASYMPTOTIC_FROM:
        total += 1 / (x * x)
        x += 1
    series = sum(b / x ** (2 * k + 1) for k, b in enumerate(BERNOULLI, start=1))
    return total + 1 / x + 1 / (2 * x * x) + series


def t_degrees_step(nu: float, n: float, logs: float, pulls: float, squares: float) -> float:
    """Newton step in log(nu) on the likelihood of Student t errors, all else fixed.

    ``logs`` is the sum of log(1 + d / nu) over rows of squared scaled residual d,
    ``pulls`` that of d / (nu + d) and ``squares`` that of its square.  Where the
    likelihood is not concave the step follows its slope.
    """
    half, more = nu / 2, (nu + 1) / 2
    slope = n / 2 * (digamma(more) - digamma(half) - 1 / nu) - logs / 2 + more / nu * pulls
    # Derivatives of the sums: logs' = -pulls / nu and pulls' = -(pulls - squares) / nu.
    bend = (
        n / 2 * (trigamma(more) / 2 - trigamma(half) / 2 + 1 / (nu * nu))
        + pulls / (2 * nu)
        - pulls / (2 * nu * nu)
        - more / (nu * nu) * (pulls - squares)
    )
    curve = nu * slope + nu * nu * bend
    step = -nu * slope / curve if curve < 0 else math.copysign(0.5, slope)
    return max(-1.0, min(1.0, step))


def t_scale_step(nu: float, n: float, logs: float, pulls: float, squares: float) -> tuple[float, float] | None:
    """Newton step in log(squared scale) and log(nu) together, sums as in :func:`t_degrees_step`.

    None where the likelihood is not concave in the two, or the step leaves its neighbourhood.
    """
    half, more = nu / 2, (nu + 1) / 2
    by_scale = -n / 2 + more * pulls
    by_nu = nu * (n / 2 * (digamma(more) - digamma(half) - 1 / nu) - logs / 2 + more / nu * pulls)
    bend = (
        n / 2 * (trigamma(more) / 2 - trigamma(half) / 2 + 1 / (nu * nu))
        + pulls / (2 * nu)
        - pulls / (2 * nu * nu)
        - more / (nu * nu) * (pulls - squares)
    )
    aa, bb = -more * (pulls - squares), by_nu + nu * nu * bend
    ab = nu * pulls / 2 - more * (pulls - squares)
    det = aa * bb - ab * ab
    if aa >= 0 or det <= 0:
        return None
    steps = (ab * by_nu - bb * by_scale) / det, (ab * by_scale - aa * by_nu) / det
    return steps if max(map(abs, steps)) < 1 else None
