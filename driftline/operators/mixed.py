"""Random-intercept models and cluster bootstrap from per-animal sums.

Rows are reduced to sums per animal by mergeable aggregates, so one animal
with most of the rows costs no more than any other.  Everything after that
works on the reduced tables.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.scalars import keyed_uniform, poisson_one
from driftline.operators.filters import require
from driftline.operators.linear import INTERCEPT, Moments, moments
from driftline.session import settle


@dataclass(frozen=True)
class MixedFit:
    response: str
    predictors: list[str]
    key: str
    coef: np.ndarray
    cov: np.ndarray
    sigma2: float
    sigma2_group: float
    ratio: float
    criterion: float
    n: int
    centre: np.ndarray
    centred_coef: np.ndarray
    sums: DataFrame

    @property
    def terms(self) -> list[str]:
        return [INTERCEPT, *self.predictors]

    @property
    def std_error(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cov))


def _z(columns: Sequence[str], mean: np.ndarray) -> list[Column]:
    return [F.col(c) - F.lit(float(m)) for c, m in zip(columns, mean)]


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def _symmetric(p: int, values: Sequence[float]) -> np.ndarray:
    full = np.empty((p, p))
    for (i, j), v in zip(_pairs(p), values):
        full[i, j] = full[j, i] = v
    return full


def group_sums(df: DataFrame, key: str, columns: Sequence[str], mean: np.ndarray) -> DataFrame:
    """Per animal: row count ``_n`` and sums ``_s0, _s1, ...`` of the centred columns."""
    sums = [F.sum(z).alias(f"_s{i}") for i, z in enumerate(_z(columns, mean))]
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *sums)


def group_gram(df: DataFrame, key: str, columns: Sequence[str], mean: np.ndarray) -> DataFrame:
    """:func:`group_sums` plus sums of products ``_g0_0, _g0_1, ...``."""
    z = _z(columns, mean)
    products = [F.sum(z[i] * z[j]).alias(f"_g{i}_{j}") for i, j in _pairs(len(columns))]
    sums = [F.sum(c).alias(f"_s{i}") for i, c in enumerate(z)]
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *sums, *products)


def _by_size(sums: DataFrame, p: int) -> DataFrame:
    """Collapse animals of equal row count: the criterion depends on nothing else."""
    outer = [F.sum(F.col(f"_s{i}") * F.col(f"_s{j}")).alias(f"_o{i}_{j}") for i, j in _pairs(p)]
    linear = [F.sum(f"_s{i}").alias(f"_t{i}") for i in range(p)]
    return sums.groupBy("_n").agg(F.count(F.lit(1)).alias("_m"), *linear, *outer)


def _evaluate(sizes: DataFrame, m: Moments, ratios: Sequence[float]) -> dict[float, tuple]:
    """Restricted criterion, the reduced cross-products and the criterion's slope in the
    logarithm of the ratio, at each variance ratio."""
    p = len(m.mean)
    n, t = F.col("_n"), F.col("_t")
    shrink = t / (1 + n * t)
    change = 1 / ((1 + n * t) * (1 + n * t))
    at = sizes.withColumn("_t", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    rows = at.groupBy("_t").agg(
        F.sum(F.col("_m") * F.log1p(n * t)),
        F.sum(shrink * F.col("_m") * n * n),
        *[F.sum(shrink * n * F.col(f"_t{i}")) for i in range(p)],
        *[F.sum(shrink * F.col(f"_o{i}_{j}")) for i, j in _pairs(p)],
        F.sum(change * F.col("_m") * n * n),
        *[F.sum(change * n * F.col(f"_t{i}")) for i in range(p)],
        *[F.sum(change * F.col(f"_o{i}_{j}")) for i, j in _pairs(p)],
        F.sum(F.col("_m") * n / (1 + n * t)),
    ).collect()
    found = {}
    for row in rows:
        gram, moved = np.zeros((p + 1, p + 1)), np.zeros((p + 1, p + 1))
        half = 1 + p + len(_pairs(p))
        for into, values in ((gram, row[2 : 2 + half]), (moved, row[2 + half : 2 + 2 * half])):
            into[0, 0] = values[0]
            into[0, 1:] = into[1:, 0] = values[1 : 1 + p]
            into[1:, 1:] = _symmetric(p, values[1 + p :])
        gram = -gram
        gram[0, 0] += m.n
        gram[1:, 1:] += m.cross
        xx, xy, yy = gram[:-1, :-1], gram[:-1, -1], gram[-1, -1]
        beta = np.linalg.solve(xx, xy)
        rss = yy - xy @ beta
        free = m.n - p
        criterion = free * math.log(rss / free) + row[1] + np.linalg.slogdet(xx)[1]
        c = np.append(-beta, 1.0)
        lost = free * (c @ moved @ c) / rss + np.trace(np.linalg.solve(xx, moved[:-1, :-1]))
        found[row[0]] = (float(criterion), beta, xx, float(rss / free), float(row[0] * (row[-1] - lost)))
    return found


# First search range for log10 of the variance ratio and step of each round.
RATIO_LOW = -8.0
RATIO_HIGH = 6.0
RATIO_STEPS = (0.5, 0.05, 0.005, 0.0005)
# Beyond this power of ten the residual variance is numerically zero.
RATIO_LIMIT = 60.0
# Secant steps from the finest grid, and the distance of the first two points.
SECANT_STEPS = 4
SECANT_SPAN = 1e-4


def random_intercept_fit(df: DataFrame, response: str, predictors: Sequence[str], key: str) -> MixedFit:
    """Exact REML fit of ``response ~ predictors + (1 | key)``.

    The variance ratio is found on successively finer grids, all values of a
    grid in one pass over the table of group sizes, and then where the criterion's
    slope vanishes, by secant steps.  The first grid moves up
    until its minimum lies inside; a ratio that tends to zero is taken as zero,
    one that tends to infinity raises.
    """
    columns = [*predictors, response]
    rows = require(df.select(key, *columns), [key, *columns])
    m = moments(rows, columns)
    sums = settle(group_sums(rows, key, columns, m.mean))
    sizes = settle(_by_size(sums, len(columns)))

    low, high = RATIO_LOW, RATIO_HIGH
    for step in RATIO_STEPS:
        while True:
            count = round((high - low) / step)
            logs = [low + step * i for i in range(count + 1)]
            found = _evaluate(sizes, m, [10.0**v for v in logs])
            scores = [found[10.0**v][0] for v in logs]
            best = int(np.argmin(scores))
            if step != RATIO_STEPS[0] or best < count:
                break
            if high >= RATIO_LIMIT:
                raise ValueError(f"the variance ratio exceeds 1e{RATIO_LIMIT:.0f}")
            low, high = high - step, high + RATIO_HIGH - RATIO_LOW
        low, high = logs[max(best - 1, 0)], logs[min(best + 1, count)]
    middle = logs[best]
    if 0 < best < count:
        middle = _flat(sizes, m, middle, logs[best - 1], logs[best + 1])
    ratio = float(10.0**middle)
    final = _evaluate(sizes, m, [ratio, 0.0])
    if final[0.0][0] <= final[ratio][0]:
        ratio = 0.0
    criterion, beta, xx, sigma2, _ = final[ratio]

    # Undo the centring of predictors and response.
    back = np.eye(len(columns))
    back[0, 1:] = -m.mean[:-1]
    coef = back @ beta
    coef[0] += m.mean[-1]
    cov = sigma2 * back @ np.linalg.inv(xx) @ back.T
    return MixedFit(
        response, list(predictors), key, coef, cov, sigma2, ratio * sigma2, ratio, criterion, m.n, m.mean, beta, sums
    )


def _flat(sizes: DataFrame, m: Moments, start: float, low: float, high: float) -> float:
    """Where between ``low`` and ``high`` the criterion has no slope (log10 of the ratio)."""
    one, two = start, start + SECANT_SPAN
    found = _evaluate(sizes, m, [10.0**one, 10.0**two])
    here, there = found[10.0**one][4], found[10.0**two][4]
    for _ in range(SECANT_STEPS):
        if there == here:
            break
        following = min(max(two - there * (two - one) / (there - here), low), high)
        one, here, two = two, there, following
        there = _evaluate(sizes, m, [10.0**two])[10.0**two][4]
    return two


def group_effects(fit: MixedFit, name: str = "effect") -> DataFrame:
    """Best linear unbiased prediction of each animal's intercept shift."""
    left = F.col(f"_s{len(fit.predictors)}") - F.lit(float(fit.centred_coef[0])) * F.col("_n")
    for i, b in enumerate(fit.centred_coef[1:]):
        left = left - F.lit(float(b)) * F.col(f"_s{i}")
    shrink = F.lit(float(fit.ratio)) / (1 + F.col("_n") * F.lit(float(fit.ratio)))
    return fit.sums.select(fit.key, F.col("_n").alias("n"), (shrink * left).alias(name))


def predict_by_group(grid: DataFrame, fit: MixedFit, name: str = "fit") -> DataFrame:
    """Prediction at each grid row with the animal's own intercept shift.

    Animals the fit has not seen, and rows without an animal, get the fixed part.
    """
    fixed = F.lit(float(fit.coef[0]))
    for b, column in zip(fit.coef[1:], fit.predictors):
        fixed = fixed + F.lit(float(b)) * F.col(column)
    effects = group_effects(fit, "_effect").select(fit.key, "_effect")
    joined = grid.join(effects, fit.key, "left")
    return joined.withColumn(name, fixed + F.coalesce("_effect", F.lit(0.0))).drop("_effect")


@dataclass(frozen=True)
class BootstrapFit:
    """Coefficients of the replicates (rows) with the predictor names.

    ``asked`` replicates were drawn; those whose weighted design is singular have no row.
    """

    predictors: list[str]
    coef: np.ndarray
    asked: int

    @property
    def complete(self) -> bool:
        return len(self.coef) == self.asked

    @property
    def terms(self) -> list[str]:
        return [INTERCEPT, *self.predictors]


def cluster_bootstrap(
    df: DataFrame, response: str, predictors: Sequence[str], key: str, replicates: int = 50, seed: int = 69
) -> BootstrapFit:
    """Least-squares refits with Poisson(1) weights drawn per animal and replicate.

    Weights depend only on (key, replicate, seed), so a lost executor cannot
    change them.  Rows are read once; replicates multiply only the per-animal sums.
    """
    columns = [*predictors, response]
    rows = require(df.select(key, *columns), [key, *columns])
    m = moments(rows, columns)
    p = len(columns)
    gram = group_gram(rows, key, columns, m.mean)
    drawn = gram.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn(
        "_w", poisson_one(keyed_uniform(F.col(key), F.col("_rep"), F.lit(seed)))
    )
    names = ["_n", *[f"_s{i}" for i in range(p)], *[f"_g{i}_{j}" for i, j in _pairs(p)]]
    sums = drawn.groupBy("_rep").agg(*[F.sum(F.col("_w") * F.col(c)).alias(c) for c in names])
    fits = []
    for row in sorted(sums.collect()):
        values = np.array(row[1:], dtype=float)
        full = np.empty((p + 1, p + 1))
        full[0, 0] = values[0]
        full[0, 1:] = full[1:, 0] = values[1 : p + 1]
        full[1:, 1:] = _symmetric(p, values[p + 1 :])
        if np.linalg.matrix_rank(full[:-1, :-1]) < p:
            continue
        beta = np.linalg.solve(full[:-1, :-1], full[:-1, -1])
        beta[0] += m.mean[-1] - m.mean[:-1] @ beta[1:]
        fits.append(beta)
    return BootstrapFit(list(predictors), np.array(fits), replicates)


def _replicate_predictions(fit: BootstrapFit) -> Column:
    coefs = F.lit([[float(v) for v in row] for row in fit.coef])

    def one(c: Column) -> Column:
        value = c[0]
        for i, name in enumerate(fit.predictors, start=1):
            value = value + c[i] * F.col(name)
        return value

    return F.transform(coefs, one)


def bootstrap_se(grid: DataFrame, fit: BootstrapFit, name: str = "se") -> DataFrame:
    """Standard deviation of the replicate predictions at each grid row.

    NULL if a replicate is missing: the rest would understate the spread.
    """
    if not fit.complete:
        return grid.withColumn(name, F.lit(None).cast("double"))
    count = len(fit.coef)
    predictions = F.col("_p")
    mean = F.aggregate(predictions, F.lit(0.0), lambda a, v: a + v) / count
    squares = F.aggregate(
        F.transform(predictions, lambda v: (v - F.col("_mean")) * (v - F.col("_mean"))),
        F.lit(0.0),
        lambda a, v: a + v,
    )
    return (
        grid.withColumn("_p", _replicate_predictions(fit))
        .withColumn("_mean", mean)
        .withColumn(name, F.sqrt(squares / (count - 1)))
        .drop("_p", "_mean")
    )


def bootstrap_draws(grid: DataFrame, fit: BootstrapFit, value: str = "value") -> DataFrame:
    """Long table: one row per grid row and replicate."""
    numbered = F.posexplode(_replicate_predictions(fit)).alias("draw", value)
    return grid.select("*", numbered)
