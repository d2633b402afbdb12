"""Gamma regression with log link and an intercept per animal, by Laplace's approximation.

With the log link an animal enters the likelihood only through its row count and the
sum of its responses divided by their fixed means.  So one aggregate over the rows
gives per-animal sums at several coefficient vectors at once, and the animals' modes,
the criterion and its slopes follow from these sums alone.  The outer search is
Newton's, on analytic slopes; their differences at neighbouring parameters, evaluated
in the same pass, give the curvature.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.conditional import Conditional
from driftline.operators.filters import require
from driftline.operators.linear import INTERCEPT, moments
from driftline.operators.special import digamma
from driftline.session import settle

MODE_ROUNDS = 60
SHORTEST = 1 / 64  # of a Newton step
# A group variance that would carry less than this share of an animal's residual is zero.
NO_VARIANCE = 1e-8


@dataclass(frozen=True)
class GammaMixedFit:
    """``shape`` is the gamma shape (1 / dispersion); ``loglik`` the approximated log likelihood."""

    response: str
    predictors: list[str]
    key: str
    coef: np.ndarray
    cov: np.ndarray
    shape: float
    sigma_group: float
    loglik: float
    rounds: int
    converged: bool
    n: int
    conditional: Conditional

    @property
    def terms(self) -> list[str]:
        return [INTERCEPT, *self.predictors]

    @property
    def std_error(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cov))


def _modes(n: np.ndarray, total: np.ndarray, shape: float, tau2: float) -> np.ndarray:
    """Each animal's shift of highest density; Newton steps that approach it from one side."""
    u = np.minimum(0.0, np.log(total / n))
    for _ in range(MODE_ROUNDS):
        pull = shape * total * np.exp(-u)
        step = (pull - shape * n - u / tau2) / (pull + 1 / tau2)
        u = u + step
        if np.max(np.abs(step), initial=0.0) < 1e-13:
            break
    return u


def _animal_slopes(n: np.ndarray, sums: np.ndarray, shape: float, tau2: float) -> np.ndarray:
    """Sum over animals of the criterion and its slopes in (coefficients, log shape, log tau2).

    ``sums`` has a row per animal: the sum of y / fixed mean, plain and times each predictor.
    """
    total = sums[:, 0]
    u = _modes(n, total, shape, tau2)
    shrunk = sums * np.exp(-u)[:, None]
    e, k = shrunk[:, 0], shape * shrunk[:, 0] + 1 / tau2
    pull = shape * e
    prior = u * u / (2 * tau2)
    value = -shape * (e + n * u) - prior - 0.5 * np.log(tau2 * k)
    by_coef = shape * shrunk * (1 + 1 / (2 * tau2 * k * k))[:, None]
    off = shape * (e - n)
    by_shape = -shape * (e + n * u) - 0.5 * (pull / k) * (1 - off / k)
    by_tau2 = prior - 0.5 * (pull / k) * (1 - u / (tau2 * k))
    return np.concatenate([[value.sum()], by_coef.sum(axis=0), [by_shape.sum(), by_tau2.sum()]])


def _ratio_sums(rows: DataFrame, betas: np.ndarray) -> DataFrame:
    """Per animal and coefficient vector: ``_r{k}_{i}``, sums of y / fixed mean times 1 and the predictors."""
    p = betas.shape[1]
    z = [F.lit(1.0), *[F.col(f"_z{i}") for i in range(p - 1)]]
    over = {}
    for k, beta in enumerate(betas):
        link = F.lit(float(beta[0]))
        for b, c in zip(beta[1:], z[1:], strict=True):
            link = link + F.lit(float(b)) * c
        over[f"_y{k}"] = F.col("_y") * F.exp(-link)
    sums = [F.sum(F.col(f"_y{k}") * c).alias(f"_r{k}_{i}") for k in range(len(betas)) for i, c in enumerate(z)]
    return rows.withColumns(over).groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), *sums)


def _evaluate(rows: DataFrame, points: Sequence[np.ndarray], n: int, logs: float) -> list[np.ndarray]:
    """Log likelihood and slopes at parameter vectors (coefficients, log shape, log tau2), in one pass."""
    p = len(points[0]) - 2
    betas = np.unique(np.array([x[:p] for x in points]), axis=0)
    which = [int(np.flatnonzero((betas == x[:p]).all(axis=1))[0]) for x in points]
    tails = [(math.exp(x[p]), math.exp(x[p + 1])) for x in points]

    def reduce_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0.0
        for pdf in batches:
            if len(pdf):
                count = pdf["_n"].to_numpy(float)
                total = total + np.concatenate([
                    _animal_slopes(count, pdf[[f"_r{k}_{i}" for i in range(p)]].to_numpy(), *tail)
                    for k, tail in zip(which, tails, strict=True)])
        if np.ndim(total):
            yield pd.DataFrame({"place": np.arange(len(total)), "part": total})

    parts = _ratio_sums(rows, betas).mapInPandas(reduce_partition, "place int, part double")
    found = np.array([v for _, v in sorted(parts.groupBy("place").agg(F.sum("part")).collect())])
    out = []
    for x, own in zip(points, found.reshape(len(points), p + 3), strict=True):
        log_shape, shape = x[p], math.exp(x[p])
        own = own.copy()
        own[0] += -shape * n * x[0] + n * (shape * log_shape - math.lgamma(shape)) + (shape - 1) * logs
        own[1] -= shape * n
        own[p + 1] += shape * (-n * x[0] + n * (log_shape + 1 - digamma(shape)) + logs)
        out.append(own)
    return out


def _curvature(rows, at: np.ndarray, n: int, logs: float, free: np.ndarray, step: float, both: bool) -> tuple:
    """Value, slopes and second derivatives at a point, over the parameters that are ``free``."""
    sides = [1, -1] if both else [1]
    points = [at]
    for j in np.flatnonzero(free):
        for side in sides:
            points.append(at + side * step * np.eye(len(at))[j])
    found = _evaluate(rows, points, n, logs)
    moved = np.array([f[1:] for f in found[1:]])
    bend = (moved[::2] - moved[1::2]) / (2 * step) if both else (moved - found[0][1:]) / step
    bend = bend[:, free]
    return found[0][0], found[0][1:], (bend + bend.T) / 2


def gamma_mixed_fit(
    df: DataFrame,
    response: str,
    predictors: Sequence[str],
    key: str,
    max_rounds: int = 40,
    tol: float = 1e-7,
) -> GammaMixedFit:
    """Maximum likelihood fit of a gamma model with log link, ``response ~ predictors + (1 | key)``.

    The likelihood integrates the animals' shifts by Laplace's approximation at their
    modes.  Rows with a NULL in any column are left out; a response that is not
    positive raises.  A group variance that tends to zero is taken as zero.  Standard
    errors allow for the estimated variances.  ``converged`` tells whether all slopes
    vanished within ``max_rounds``.
    """
    columns, p = [*predictors, response], len(predictors) + 1
    complete = require(df.select(key, *columns), [key, *columns])
    if complete.where(F.col(response) <= 0).limit(1).count():
        raise ValueError("a gamma response must be positive")
    logged = complete.withColumn("_log", F.log(response))
    m = moments(logged, [*predictors, "_log"])
    scale = np.sqrt(np.diag(m.cross)[:-1] / m.n)
    scale[scale == 0] = 1.0
    rows = settle(logged.select(F.col(key).alias("_key"), F.col(response).cast("double").alias("_y"), *[
        ((F.col(c) - F.lit(float(a))) / F.lit(float(b))).alias(f"_z{i}")
        for i, (c, a, b) in enumerate(zip(predictors, m.mean, scale, strict=False))]))
    unit = m.cross[:-1, :-1] / np.outer(scale, scale)
    slopes = np.linalg.solve(unit, m.cross[:-1, -1] / scale) if p > 1 else np.zeros(0)
    spread = max(float(m.cross[-1, -1] - m.cross[:-1, -1] / scale @ slopes) / m.n, 1e-12)
    logs = float(m.mean[-1] * m.n)

    at = np.concatenate([[m.mean[-1] + spread / 4], slopes, [math.log(2 / spread), math.log(spread / 2)]])
    free = np.ones(p + 2, bool)
    groups = rows.agg(F.count_distinct("_key")).first()[0]
    best, rounds, length, converged = None, 0, 1.0, False
    while rounds < max_rounds and not converged:
        rounds += 1
        value, slope, bend = _curvature(rows, at, m.n, logs, free, 1e-5, False)
        if best is not None and value < best[0] - 1e-9 * abs(best[0]) and length > SHORTEST:
            length /= 4  # too far: back towards the last point
        else:
            size = np.linalg.eigvalsh(-bend)
            curve = -bend if size[0] > 0 else -bend + (1e-3 * size[-1] - size[0]) * np.eye(len(bend))
            move = np.zeros(p + 2)
            move[free] = np.linalg.solve(curve, slope[free])
            best, length = (value, at, move / max(1.0, np.max(np.abs(move[p:])) / 1.5)), 1.0
            converged = bool(size[0] > 0 and np.max(np.abs(move)) < tol)
        at = best[1] + length * best[2]
        if free[p + 1] and math.exp(at[p] + at[p + 1]) * m.n / groups < NO_VARIANCE:
            free[p + 1], best = False, None
    value, slope, bend = _curvature(rows, at, m.n, logs, free, 1e-4, True)
    inverse = np.linalg.inv(-bend)[:p, :p]

    back = np.eye(p)
    back[1:, 1:] = np.diag(1 / scale)
    back[0, 1:] = -m.mean[:-1] / scale
    shape, tau2 = math.exp(at[p]), math.exp(at[p + 1]) if free[p + 1] else 0.0
    animals = _effects(rows, key, at[:p], shape, tau2)
    return GammaMixedFit(
        response, list(predictors), key, back @ at[:p], back @ inverse @ back.T, shape, math.sqrt(tau2), float(value),
        rounds, converged, m.n,
        Conditional(list(predictors), key, m.mean[:-1], scale, 0.0, 1.0, at[:p], inverse, [0], animals))


def _effects(rows: DataFrame, key: str, beta: np.ndarray, shape: float, tau2: float) -> DataFrame:
    p = len(beta)
    sums = _ratio_sums(rows, beta[None, :])

    def shifts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                n, own = pdf["_n"].to_numpy(float), pdf[[f"_r0_{i}" for i in range(p)]].to_numpy()
                u = _modes(n, own[:, 0], shape, tau2) if tau2 else np.zeros(len(n))
                own = shape * own * np.exp(-u)[:, None]
                spread = tau2 / (1 + tau2 * own[:, 0])
                yield pd.DataFrame({
                    "key": pdf["_key"], "n": pdf["_n"], "shifts": list(u[:, None]),
                    "lean": list(own * spread[:, None]), "spread": list(spread[:, None])})

    kind = rows.schema["_key"].dataType.simpleString()
    made = sums.mapInPandas(shifts, f"key {kind}, n long, shifts array<double>, lean array<double>, spread array<double>")
    return settle(made.withColumnRenamed("key", key))


def gamma_effects(fit: GammaMixedFit, name: str = "effect") -> DataFrame:
    """Most likely intercept shift of each animal on the log scale and its standard deviation."""
    return fit.conditional.animals.select(
        fit.key, "n", F.col("shifts")[0].alias(name), F.sqrt(F.col("spread")[0]).alias("sd"))
