"""Least squares from one pass of aggregates.

Spark computes means and centred cross-products; only these p x p numbers
reach the driver, where the normal equations are solved.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.distributions import t_quantile, t_tail
from driftline.functions.scalars import band
from driftline.operators.filters import require

INTERCEPT = "(Intercept)"


@dataclass(frozen=True)
class Moments:
    """Row count, means and centred cross-products of a list of columns."""

    n: int
    mean: np.ndarray
    cross: np.ndarray


@dataclass(frozen=True)
class LinearFit:
    """``coef`` and ``cov`` are NaN for predictors that earlier ones already determine."""

    response: str
    predictors: list[str]
    coef: np.ndarray
    cov: np.ndarray
    sigma: float
    r2: float
    n: int

    @property
    def terms(self) -> list[str]:
        return [INTERCEPT, *self.predictors]

    @property
    def rank(self) -> int:
        return int(np.isfinite(self.coef).sum())

    @property
    def df_residual(self) -> int:
        return self.n - self.rank

    @property
    def std_error(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cov))


def moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c) for c in columns],
        *[
            F.var_pop(columns[i]) if i == j else F.covar_pop(columns[i], columns[j])
            for i, j in pairs
        ],
    ).first()
    n, p = row[0], len(columns)
    if n == 0:
        raise ValueError("no complete rows to fit")
    cross = np.empty((p, p))
    for (i, j), value in zip(pairs, row[1 + p :]):
        cross[i, j] = cross[j, i] = value * n
    return Moments(n, np.array(row[1 : 1 + p], dtype=float), cross)


# A predictor is aliased if earlier ones leave less than this share of its sum of squares.
ALIASED = 1e-10


def independent(cross: np.ndarray) -> list[int]:
    """Places of the predictors that earlier ones do not determine, from centred cross-products."""
    kept: list[int] = []
    for j in range(len(cross)):
        left = cross[j, j]
        if kept:
            left = left - cross[j, kept] @ np.linalg.solve(cross[np.ix_(kept, kept)], cross[kept, j])
        if left > ALIASED * cross[j, j]:
            kept.append(j)
    return kept


def ols_fit(df: DataFrame, response: str, predictors: Sequence[str]) -> LinearFit:
    """Least squares with an intercept; predictors that earlier ones determine have no coefficient.

    Without residual degrees of freedom the standard errors are NaN.
    """
    columns = [*predictors, response]
    m = moments(require(df.select(*columns), columns), columns)
    kept = independent(m.cross[:-1, :-1])
    places = [0, *[j + 1 for j in kept]]
    sxx, sxy, syy = m.cross[np.ix_(kept, kept)], m.cross[kept, -1], m.cross[-1, -1]
    inverse = np.linalg.inv(sxx)
    slopes = inverse @ sxy
    rss = max(syy - slopes @ sxy, 0.0)
    free = m.n - len(places)
    sigma2 = rss / free if free > 0 else float("nan")
    xbar = m.mean[kept]
    coef = np.full(len(columns), np.nan)
    coef[places] = [m.mean[-1] - xbar @ slopes, *slopes]
    lean = inverse @ xbar
    scale = np.empty((len(places), len(places)))
    scale[0, 0] = 1 / m.n + xbar @ lean
    scale[0, 1:] = scale[1:, 0] = -lean
    scale[1:, 1:] = inverse
    cov = np.full((len(columns), len(columns)), np.nan)
    cov[np.ix_(places, places)] = sigma2 * scale
    r2 = 1 - rss / syy if syy > 0 else float("nan")
    return LinearFit(response, list(predictors), coef, cov, float(np.sqrt(sigma2)), r2, m.n)


def coef_table(spark: SparkSession, fit, exp: bool = False, p_value: bool = False) -> DataFrame:
    """Terms with estimate, standard error and t, NULL for aliased ones.

    ``exp`` adds response-scale slopes; ``p_value`` the two-sided probability of a
    larger t, for fits that know their residual degrees of freedom.
    """
    rows = [
        (term, float(b), float(se), float(b / se) if se > 0 else None) if np.isfinite(b) else (term, None, None, None)
        for term, b, se in zip(fit.terms, fit.coef, fit.std_error)
    ]
    table = spark.createDataFrame(rows, "term string, estimate double, std_error double, t_value double")
    if p_value:
        table = table.withColumn("p_value", t_tail(F.col("t_value"), F.lit(fit.df_residual)))
    return table.withColumn("response_scale", F.exp("estimate")) if exp else table


def fit_summary(spark: SparkSession, fit: LinearFit) -> DataFrame:
    row = (int(fit.n), len(fit.predictors), float(fit.sigma), float(fit.r2))
    return spark.createDataFrame([row], "n bigint, predictors int, sigma double, r2 double")


def linear_predictor(terms: Sequence[str], coef: Sequence[float]) -> Column:
    value = F.lit(float(coef[0]))
    for name, b in zip(terms[1:], coef[1:]):
        if np.isnan(b):
            continue  # aliased: earlier terms carry it
        value = value + F.lit(float(b)) * F.col(name)
    return value


def with_residuals(df: DataFrame, fit, fitted: str = "fitted", residual: str = "residual") -> DataFrame:
    scored = df.withColumn(fitted, linear_predictor(fit.terms, fit.coef))
    return scored.withColumn(residual, F.col(fit.response) - F.col(fitted))


def predict_grid(grid: DataFrame, fit, scale: str = "link", name: str = "prediction") -> DataFrame:
    """Fixed-effect prediction per grid row; ``scale='response'`` undoes a log link."""
    eta = linear_predictor(fit.terms, fit.coef)
    return grid.withColumn(name, F.exp(eta) if scale == "response" else eta)


def mean_standard_error(fit) -> Column:
    """Standard error of the fitted mean at the predictor values of a row."""
    columns = {0: F.lit(1.0)} | {i: F.col(p) for i, p in enumerate(fit.predictors, start=1) if np.isfinite(fit.coef[i])}
    total = F.lit(0.0)
    for i, a in columns.items():
        for j, b in columns.items():
            total = total + F.lit(float(fit.cov[i, j])) * a * b
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def predict_band(grid: DataFrame, fit) -> DataFrame:
    """Prediction on the link scale with mean and one-SE limits on the response scale."""
    linked = predict_grid(grid, fit, "link", "link").withColumn("se", mean_standard_error(fit))
    middle, low, high = band(F.col("link"), F.col("se"))
    return linked.select("*", middle.alias("mean"), low.alias("lower"), high.alias("upper"))


def line_by_group(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """Straight line per group with what a confidence band needs."""
    fits = df.groupBy(*keys).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.regr_avgx(y, x).alias("x_mean"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("_syy"),
        F.regr_sxy(y, x).alias("_sxy"),
    )
    rss = F.col("_syy") - F.try_divide(F.col("_sxy") * F.col("_sxy"), F.col("sxx"))
    sigma = F.when(F.col("n") > 2, F.sqrt(F.greatest(rss, F.lit(0.0)) / (F.col("n") - 2)))
    return fits.withColumn("sigma", sigma).drop("_syy", "_sxy")


def line_at(lines: DataFrame, x: Column) -> DataFrame:
    """Fitted value and standard error of each group's line at ``x``."""
    lean = F.try_divide((x - F.col("x_mean")) * (x - F.col("x_mean")), F.col("sxx"))
    return lines.withColumn("fit", F.col("intercept") + F.col("slope") * x).withColumn(
        "se", F.col("sigma") * F.sqrt(F.try_divide(F.lit(1.0), F.col("n")) + lean)
    )


def line_band(lines: DataFrame, x: Column, level: float = 0.95) -> DataFrame:
    """:func:`line_at` with the limits of the confidence band; NULL for groups of two rows or fewer."""
    placed = line_at(lines, x).withColumn("_half", t_quantile(1 - level, F.col("n") - 2) * F.col("se"))
    return placed.withColumns({"lower": F.col("fit") - F.col("_half"), "upper": F.col("fit") + F.col("_half")}).drop("_half")


def breusch_pagan(df: DataFrame, response: str, predictors: Sequence[str]) -> Mapping[str, float]:
    """Studentised test of constant variance: n R2 of squared residuals on the predictors."""
    complete = require(df.select(response, *predictors), [response, *predictors])
    fit = ols_fit(complete, response, predictors)
    squared = with_residuals(complete, fit).withColumn("_e2", F.col("residual") * F.col("residual"))
    spread = ols_fit(squared, "_e2", predictors)
    return {"n": fit.n, "statistic": spread.n * spread.r2, "df": spread.rank - 1}
