"""Random intercepts and slopes per animal, fitted from per-animal cross-products."""

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
from driftline.operators.mixed import _pairs, group_gram
from driftline.session import settle


@dataclass(frozen=True)
class SlopesFit:
    """``group_cov`` is the covariance of (intercept, slopes...) between animals."""

    response: str
    predictors: list[str]
    slopes: list[str]
    key: str
    coef: np.ndarray
    cov: np.ndarray
    sigma2: float
    group_cov: np.ndarray
    criterion: float
    n: int
    converged: bool
    centre: np.ndarray
    reduced: tuple

    @property
    def terms(self) -> list[str]:
        return [INTERCEPT, *self.predictors]

    @property
    def std_error(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cov))


def _animals(pdf: pd.DataFrame, p: int, scale: np.ndarray, where: list[int], d: np.ndarray) -> tuple:
    """Scaled cross-products of the animals of one Arrow batch and what shrinks them."""
    full = np.empty((len(pdf), p + 1, p + 1))
    full[:, 0, 0] = pdf["_n"]
    for i in range(p):
        full[:, 0, i + 1] = full[:, i + 1, 0] = pdf[f"_s{i}"] / scale[i]
    for i, j in _pairs(p):
        full[:, i + 1, j + 1] = full[:, j + 1, i + 1] = pdf[f"_g{i}_{j}"] / (scale[i] * scale[j])
    zx = full[:, where, :]
    inner = np.eye(len(where)) + zx[:, :, where] @ d
    a = d @ np.linalg.inv(inner)
    return full, inner, a, zx, a @ zx


def _batch_sums(pdf: pd.DataFrame, p: int, scale: np.ndarray, where: list[int], d: np.ndarray) -> np.ndarray:
    """Sums over the animals of one Arrow batch, all animals at once."""
    full, inner, a, zx, h = _animals(pdf, p, scale, where, d)
    reduced = full - np.swapaxes(zx, 1, 2) @ h
    flat = h.reshape(len(pdf), -1)
    outer = np.einsum("bi,bj->ij", flat, flat)
    parts = [reduced.sum(axis=0), outer, a.sum(axis=0), np.linalg.slogdet(inner)[1].sum(), len(pdf)]
    return np.concatenate([np.ravel(v) for v in parts])


def _sums(gram: DataFrame, p: int, scale: np.ndarray, where: list[int], d: np.ndarray) -> np.ndarray:
    def reduce_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0.0
        for pdf in batches:
            if len(pdf):
                total = total + _batch_sums(pdf, p, scale, where, d)
        if np.ndim(total):
            yield pd.DataFrame({"place": np.arange(len(total)), "part": total})

    rows = gram.mapInPandas(reduce_partition, "place int, part double").groupBy("place").agg(F.sum("part")).collect()
    return np.array([v for _, v in sorted(rows)])


@dataclass(frozen=True)
class _Step:
    criterion: float
    beta: np.ndarray
    inverse: np.ndarray
    sigma2: float
    next_d: np.ndarray


def _step(gram, p, scale, where, d, n) -> _Step:
    """Restricted criterion at ``d`` and the next value of ``d``, in one pass over the animals."""
    q, width = len(where), p + 1
    values = _sums(gram, p, scale, where, d)
    cut = np.cumsum([width**2, (q * width) ** 2, q * q, 1])
    full, outer, a_sum, logs, groups = np.split(values, cut)
    full = full.reshape(width, width)
    outer = outer.reshape(q, width, q, width)
    xx, xy, yy = full[:-1, :-1], full[:-1, -1], full[-1, -1]
    inverse = np.linalg.inv(xx)
    beta = inverse @ xy
    free = n - p
    rss = yy - xy @ beta
    sigma2 = rss / free
    criterion = free * math.log(sigma2) + logs[0] + np.linalg.slogdet(xx)[1]
    c = np.append(-beta, 1.0)
    effects = np.einsum("iajb,a,b->ij", outer, c, c)
    spread = np.einsum("iajb,ab->ij", outer[:, :-1, :, :-1], inverse)
    next_d = (effects / sigma2 + a_sum.reshape(q, q) + spread) / groups[0]
    return _Step(float(criterion), beta, inverse, float(sigma2), (next_d + next_d.T) / 2)


def random_slopes_fit(
    df: DataFrame,
    response: str,
    predictors: Sequence[str],
    slopes: Sequence[str],
    key: str,
    max_rounds: int = 100,
    tol: float = 1e-6,
) -> SlopesFit:
    """REML fit of ``response ~ predictors + (1 + slopes | key)``; ``slopes`` are among the predictors.

    Expectation-maximisation with squared extrapolation.  A round is at most
    three passes over the table of per-animal cross-products.
    """
    columns = [*predictors, response]
    rows = require(df.select(key, *columns), [key, *columns])
    m = moments(rows, columns)
    p = len(columns)
    scale = np.sqrt(np.diag(m.cross) / m.n)
    gram = settle(group_gram(rows, key, columns, m.mean))
    where = [0, *[list(predictors).index(s) + 1 for s in slopes]]

    def at(d):
        return _step(gram, p, scale, where, d, m.n)

    d = 0.1 * np.eye(len(where))
    current, converged = at(d), False
    for _ in range(max_rounds):
        first = at(current.next_d)
        r = current.next_d - d
        v = first.next_d - current.next_d - r
        d, current = current.next_d, first
        if np.max(np.abs(r)) < tol * (1 + np.max(np.abs(d))):
            converged = True
            break
        if np.any(v):
            alpha = max(1.0, math.sqrt((r * r).sum() / (v * v).sum()))
            leap = d - r + 2 * alpha * r + alpha * alpha * v
            if np.all(np.linalg.eigvalsh(leap) > 0):
                tried = at(leap)
                if tried.criterion < current.criterion:
                    d, current = leap, tried

    back = np.eye(p)
    back[0, 1:] = -m.mean[:-1] / scale[:-1]
    back[1:, 1:] = np.diag(1 / scale[:-1])
    coef = scale[-1] * (back @ current.beta)
    coef[0] += m.mean[-1]
    sigma2 = float(current.sigma2 * scale[-1] ** 2)
    group_back = back[np.ix_(where, where)]
    return SlopesFit(
        response,
        list(predictors),
        list(slopes),
        key,
        coef,
        sigma2 * back @ current.inverse @ back.T,
        sigma2,
        sigma2 * group_back @ d @ group_back.T,
        current.criterion,
        m.n,
        converged,
        m.mean,
        (gram, p, scale, where, d, current.beta, scale[-1] * group_back, current.sigma2 * current.inverse),
    )


def slope_effects(fit: SlopesFit) -> DataFrame:
    """Best linear unbiased prediction of each animal's shift of intercept and slopes.

    One row per animal: the key, ``n`` and a column for every random term, to be
    added to the fixed coefficient of that name.
    """
    gram, p, scale, where, d, beta, back, _ = fit.reduced
    key, terms = fit.key, [INTERCEPT, *fit.slopes]
    key_type = gram.schema[key].dataType.simpleString()
    schema = ", ".join([f"`{key}` {key_type}", "n long", *[f"`{t}` double" for t in terms]])

    def shifts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                h = _animals(pdf, p, scale, where, d)[-1]
                own = h @ np.append(-beta, 1.0) @ back.T
                yield pd.DataFrame({key: pdf[key], "n": pdf["_n"], **dict(zip(terms, own.T))})

    return gram.mapInPandas(shifts, schema)


def slopes_conditional(fit: SlopesFit) -> Conditional:
    """What :func:`predict_conditional` needs to predict at each animal's own line."""
    gram, p, scale, where, d, beta, _, cov = fit.reduced
    q, unit, ratio = len(where), float(scale[-1]), fit.sigma2 / float(scale[-1]) ** 2
    key = fit.key
    kind = gram.schema[key].dataType.simpleString()

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                _, _, a, _, h = _animals(pdf, p, scale, where, d)
                yield pd.DataFrame({
                    "key": pdf[key], "shifts": list(h @ np.append(-beta, 1.0)),
                    "lean": list(h[:, :, :-1].reshape(len(pdf), q * p)),
                    "spread": list(ratio * a.reshape(len(pdf), q * q))})

    animals = gram.mapInPandas(own, f"key {kind}, shifts array<double>, lean array<double>, spread array<double>")
    return Conditional(
        fit.predictors, fit.key, fit.centre[:-1], scale[:-1], float(fit.centre[-1]), unit, beta, cov, where,
        settle(animals.withColumnRenamed("key", key)))
