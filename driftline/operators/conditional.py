"""Predictions at an animal's own coefficients, with their standard error.

A fit with random terms leaves three arrays per animal: its shifts of the random
terms, how far these shifts move with the fixed coefficients, and their spread.
A grid joins these arrays; everything else is a column expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.scalars import band


@dataclass(frozen=True)
class Conditional:
    """What a prediction by animal needs, in centred and scaled predictors.

    ``coef`` and ``cov`` belong to (intercept, predictors...); ``where`` names the places
    of the random terms among them.  ``animals`` has the key, ``shifts`` (one a random
    term), ``lean`` (shifts against coefficients, row by row) and ``spread`` (their
    covariance, row by row).  A fitted value is ``offset + unit * linear predictor``.
    """

    predictors: list[str]
    key: str
    centre: np.ndarray
    scale: np.ndarray
    offset: float
    unit: float
    coef: np.ndarray
    cov: np.ndarray
    where: list[int]
    animals: DataFrame


def _total(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def predict_conditional(grid: DataFrame, model: Conditional, fit: str = "fit", se: str = "se") -> DataFrame:
    """Add the prediction at each grid row's animal and its standard error.

    The error covers the fixed coefficients and the animal's shifts, given the
    variances.  Animals the fit has not seen, and rows without one, get the fixed
    part and its error.  The rows of ``grid`` stay as they are.
    """
    p, q = len(model.coef), len(model.where)
    arrays = {"shifts": q, "lean": q * p, "spread": q * q}
    own = model.animals.select(
        F.col(model.key).alias("_own_key"), *[F.col(c).alias(f"_own_{c}") for c in arrays])
    joined = grid.join(own, F.col(model.key) == F.col("_own_key"), "left").withColumns({
        f"_own_{c}": F.coalesce(F.col(f"_own_{c}"), F.lit([0.0] * size)) for c, size in arrays.items()})
    x = [F.lit(1.0)] + [
        (F.col(c) - F.lit(float(m))) / F.lit(float(s))
        for c, m, s in zip(model.predictors, model.centre, model.scale, strict=True)]
    placed = joined.withColumns({f"_own_x{i}": c for i, c in enumerate(x)})
    x = [F.col(f"_own_x{i}") for i in range(p)]
    z = [x[i] for i in model.where]
    shifts, lean, spread = (F.col(f"_own_{c}") for c in arrays)
    link = _total([F.lit(float(b)) * c for b, c in zip(model.coef, x, strict=True)])
    link = link + _total([shifts[i] * c for i, c in enumerate(z)])
    left = [x[j] - _total([lean[i * p + j] * c for i, c in enumerate(z)]) for j in range(p)]
    placed = placed.withColumns({f"_own_d{j}": c for j, c in enumerate(left)})
    d = [F.col(f"_own_d{j}") for j in range(p)]
    fixed = _total([F.lit(float(model.cov[i, j])) * d[i] * d[j] for i in range(p) for j in range(p)])
    moving = _total([spread[i * q + j] * z[i] * z[j] for i in range(q) for j in range(q)])
    made = placed.withColumns({
        fit: F.lit(float(model.offset)) + F.lit(float(model.unit)) * link,
        se: F.lit(abs(float(model.unit))) * F.sqrt(F.greatest(fixed + moving, F.lit(0.0))),
    })
    kept = [c for c in grid.columns if c not in (fit, se)]
    return made.select(*kept, fit, se)


def predict_conditional_band(grid: DataFrame, model: Conditional, width: float = 1.0) -> DataFrame:
    """:func:`predict_conditional` of a log-link model with mean and limits on the response scale.

    The limits lie ``width`` standard errors from the mean on the link scale.
    """
    linked = predict_conditional(grid, model, "link", "se")
    middle, low, high = band(F.col("link"), F.lit(float(width)) * F.col("se"))
    return linked.select("*", middle.alias("mean"), low.alias("lower"), high.alias("upper"))
