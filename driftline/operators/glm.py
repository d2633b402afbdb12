"""Gamma regression with log link and heavy-tailed (Student t) regression."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.filters import require
from driftline.operators.linear import INTERCEPT, moments
from driftline.operators.special import t_degrees_step, t_scale_step
from driftline.session import settle


@dataclass(frozen=True)
class GammaFit:
    response: str
    predictors: list[str]
    coef: np.ndarray
    std_error: np.ndarray
    dispersion: float
    deviance: float
    n: int
    rounds: int
    converged: bool

    @property
    def terms(self) -> list[str]:
        return [INTERCEPT, *self.predictors]


def gamma_glm(df: DataFrame, response: str, predictors: Sequence[str], max_rounds: int = 50) -> GammaFit:
    """Gamma regression with log link.  Fixed effects only: animals get no random effect."""
    columns = [*predictors, response]
    rows = settle(require(df.select(*columns), columns))
    packed = VectorAssembler(inputCols=list(predictors), outputCol="_features").transform(rows)
    model = GeneralizedLinearRegression(
        family="gamma",
        link="log",
        labelCol=response,
        featuresCol="_features",
        maxIter=max_rounds,
        tol=1e-12,
    ).fit(packed)
    summary = model.summary
    # The summary lists the intercept last.
    errors = summary.coefficientStandardErrors
    return GammaFit(
        response,
        list(predictors),
        np.array([model.intercept, *model.coefficients]),
        np.array([errors[-1], *errors[:-1]]),
        float(summary.dispersion),
        float(summary.deviance),
        int(summary.numInstances),
        int(summary.numIterations),
        int(summary.numIterations) < max_rounds,
    )


@dataclass(frozen=True)
class RobustFit:
    response: str
    predictors: list[str]
    coef: np.ndarray
    sigma: float
    nu: float
    nu_bound: bool
    rounds: int
    converged: bool
    n: int
    std_error: np.ndarray

    @property
    def terms(self) -> list[str]:
        return [INTERCEPT, *self.predictors]


def _weighted_sums(rows: DataFrame, z: Sequence[Column], distance: Column, nu: float) -> tuple:
    """Cross-products weighted by (nu + 1) / (nu + distance), and what a step in ``nu`` needs."""
    p = len(z)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    weighted = rows.select(distance.alias("_d"), *[c.alias(f"_z{i}") for i, c in enumerate(z)])
    w, pull = F.lit(nu + 1) / (F.lit(nu) + F.col("_d")), F.col("_d") / (F.lit(nu) + F.col("_d"))
    row = weighted.withColumns({"_w": w, "_p": pull}).agg(
        F.sum("_w"),
        *[F.sum(F.col("_w") * F.col(f"_z{i}")) for i in range(p)],
        *[F.sum(F.col("_w") * F.col(f"_z{i}") * F.col(f"_z{j}")) for i, j in pairs],
        F.sum(F.log1p(F.col("_d") / F.lit(nu))), F.sum("_p"), F.sum(F.col("_p") * F.col("_p")),
    ).first()
    gram = np.empty((p + 1, p + 1))
    gram[0, 0] = row[0]
    gram[0, 1:] = gram[1:, 0] = row[1 : p + 1]
    for (i, j), v in zip(pairs, row[p + 1 :]):
        gram[i + 1, j + 1] = gram[j + 1, i + 1] = v
    return gram, tuple(row[-3:])


START_NU = 4.0
NU_RANGE = (0.1, 1e6)
# Earlier rounds that a step of the acceleration looks at.
MEMORY = 4


def _accelerated(points: list[np.ndarray], moves: list[np.ndarray]) -> np.ndarray:
    """Next point of a fixed-point iteration by Anderson's mixing of the last rounds.

    The plain step is taken at first, and again whenever the last one moved farther
    than the one before it.
    """
    plain = points[-1] + moves[-1]
    size = [np.max(np.abs(m)) for m in moves[-2:]]
    if len(moves) < 2 or size[1] > size[0]:
        del points[:-1], moves[:-1]
        return plain
    del points[: -MEMORY - 1], moves[: -MEMORY - 1]
    d_moves = np.diff(moves, axis=0).T
    d_points = np.diff(points, axis=0).T
    share = np.linalg.lstsq(d_moves, moves[-1], rcond=None)[0]
    mixed = plain - (d_points + d_moves) @ share
    return mixed if np.all(np.isfinite(mixed)) and np.max(np.abs(mixed - plain)) < 1e3 * size[1] else plain


def robust_t_fit(
    df: DataFrame,
    response: str,
    predictors: Sequence[str],
    nu: float | None = 4.0,
    max_rounds: int = 40,
    tol: float = 1e-10,
) -> RobustFit:
    """Maximum likelihood for Student t errors by reweighting, ``nu`` fixed or (None) estimated.

    Degrees of freedom take a Newton step on their likelihood in every round, within
    ``NU_RANGE``; ending on a limit of it is flagged.  Each round is one mergeable aggregate over the rows, which are settled once.
    Anderson acceleration mixes the last few rounds, so that about ten suffice.
    ``converged`` tells whether the tolerance was met within ``max_rounds``.
    """
    columns = [*predictors, response]
    rows = settle(require(df.select(*columns), columns))
    m = moments(rows, columns)
    scale = np.sqrt(np.diag(m.cross) / m.n)
    scale[scale == 0] = 1.0
    z = [(F.col(c) - F.lit(float(a))) / F.lit(float(s)) for c, a, s in zip(columns, m.mean, scale)]

    sxx, sxy, syy = m.cross[:-1, :-1], m.cross[:-1, -1], m.cross[-1, -1]
    slopes = np.linalg.solve(sxx, sxy) * scale[:-1] / scale[-1]
    beta = np.concatenate([[0.0], slopes])
    sigma2 = float((syy - sxy @ np.linalg.solve(sxx, sxy)) / m.n / scale[-1] ** 2)
    estimated, nu = nu is None, START_NU if nu is None else nu
    low, high = map(math.log, NU_RANGE)
    converged, rounds = False, 0
    points: list[np.ndarray] = []
    moves: list[np.ndarray] = []
    while rounds < max_rounds and not converged:
        residual = z[-1] - F.lit(float(beta[0]))
        for b, c in zip(beta[1:], z):
            residual = residual - F.lit(float(b)) * c
        gram, sums = _weighted_sums(rows, z, residual * residual / F.lit(float(sigma2)), nu)
        xx, xy, yy = gram[:-1, :-1], gram[:-1, -1], gram[-1, -1]
        new = np.linalg.solve(xx, xy)
        # Dividing by the weight sum has the same fixed point and needs far fewer rounds.
        new_sigma2 = float((yy - xy @ new) / gram[0, 0])
        points.append(np.append(beta, [math.log(sigma2), math.log(nu)]))
        both = t_scale_step(nu, m.n, *sums) if estimated else None
        if both is not None:
            new_sigma2 = sigma2 * math.exp(both[0])
        step = both[1] if both is not None else t_degrees_step(nu, m.n, *sums) if estimated else 0.0
        new_nu = min(max(math.log(nu) + step, low), high) if estimated else math.log(nu)
        moves.append(np.append(new, [math.log(new_sigma2), new_nu]) - points[-1])
        rounds += 1
        converged = bool(np.max(np.abs(moves[-1])) < tol)
        following = _accelerated(points, moves)
        beta, sigma2 = following[:-2], math.exp(following[-2])
        nu = math.exp(min(max(following[-1], low), high)) if estimated else nu
    # Expected information of the t model.
    information = (nu + 1) / (nu + 3) / sigma2
    flat = np.empty((len(columns), len(columns)))
    flat[0, 0], flat[0, 1:], flat[1:, 0] = m.n, 0.0, 0.0
    flat[1:, 1:] = sxx / np.outer(scale[:-1], scale[:-1])
    cov = np.linalg.inv(flat) / information
    back = np.eye(len(columns))
    back[1:, 1:] = np.diag(1 / scale[:-1])
    back[0, 1:] = -m.mean[:-1] / scale[:-1]
    back *= scale[-1]
    coef = back @ beta
    coef[0] += m.mean[-1]
    error = np.sqrt(np.diag(back @ cov @ back.T))
    return RobustFit(
        response,
        list(predictors),
        coef,
        float(math.sqrt(sigma2) * scale[-1]),
        nu,
        estimated and not NU_RANGE[0] * (1 + 1e-9) < nu < NU_RANGE[1] * (1 - 1e-9),
        rounds,
        converged,
        m.n,
        error,
    )
