"""Heavy-tailed regression with an intercept per animal.

Errors follow Student's t, intercept shifts a normal distribution.  Rounds alternate
between weights of rows, given what is known of the shifts, and the normal mixed model
with these weights, which needs only sums per animal.  They climb the variational
likelihood

  sum over rows of log t density(expected squared residual) +
  sum over animals of (log variance of the shift - expected squared shift / group variance) / 2

with the shifts' posterior normal.  A round is one aggregate over the rows and one over
the animals.  Rows are laid out by animal once, so a round moves only numbers per animal.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.conditional import Conditional
from driftline.operators.filters import require
from driftline.operators.glm import NU_RANGE, START_NU, _accelerated
from driftline.operators.linear import INTERCEPT, moments
from driftline.operators.mixed import _pairs, _symmetric
from driftline.operators.special import t_degrees_step, t_scale_step
from driftline.session import settle

# Relative distance of the second variance ratio, for the secant step.
RATIO_STEP = 1e-3
# An animal with more rows is cut into pieces of about so many, each weighed by a task of its own.
PIECE_ROWS = 1_000_000
# A variance ratio whose shifts would carry less than this share of an animal's residual is zero.
NO_RATIO = 1e-8


@dataclass(frozen=True)
class StudentMixedFit:
    """``nu_bound`` tells that the degrees of freedom ended on a limit of ``NU_RANGE``."""

    response: str
    predictors: list[str]
    key: str
    coef: np.ndarray
    cov: np.ndarray
    sigma: float
    sigma_group: float
    nu: float
    nu_bound: bool
    objective: float
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


@dataclass
class _State:
    beta: np.ndarray
    sigma2: float
    ratio: float
    nu: float

    def vector(self, each: float) -> np.ndarray:
        """Coefficients and logarithms; ``each`` is the mean number of rows an animal has."""
        return np.append(self.beta, [math.log(self.sigma2), math.log1p(self.ratio * each), math.log(self.nu)])

    @classmethod
    def of(cls, vector: np.ndarray, each: float, plain: _State, free: bool) -> _State:
        """The state of a vector; ``plain`` where the vector leaves the range or a part is fixed."""
        ratio = math.expm1(vector[-2]) / each
        nu = min(max(math.exp(vector[-1]), NU_RANGE[0]), NU_RANGE[1]) if free else plain.nu
        return cls(vector[:-3], math.exp(vector[-3]), ratio if plain.ratio and ratio > 0 else plain.ratio, nu)


def _left(z: Sequence[Column], beta: np.ndarray, ones: Column) -> Column:
    value = z[-1] - F.lit(float(beta[0])) * ones
    for b, c in zip(beta[1:], z[:-1], strict=True):
        value = value - F.lit(float(b)) * c
    return value


def _laid_out(rows: DataFrame) -> DataFrame:
    """Keep ``rows`` partitioned and sorted by (``_key``, ``_piece``); later joins and sums go by that.

    They are persisted, since a checkpoint forgets how its rows are partitioned.
    """
    values = [c for c in rows.columns if c != "_key"]
    sizes = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows"))
    # At most one animal for every PIECE_ROWS rows.
    large = F.broadcast(sizes.where(F.col("_rows") > PIECE_ROWS))
    # By content, so that a task that runs again deals its rows alike.
    piece = F.pmod(F.xxhash64(*values), F.ceil(F.col("_rows") / PIECE_ROWS))
    dealt = rows.join(large, "_key", "left").select(
        "_key", F.coalesce(piece, F.lit(0)).cast("bigint").alias("_piece"), *values)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "_key", "_piece").sortWithinPartitions("_key", "_piece").persist()


def _with_shifts(rows: DataFrame, post: DataFrame) -> DataFrame:
    """Rows beside their animal's posterior, which is sent to each of its pieces; the rows stay where they are."""
    pieces = post.select("_key", F.explode(F.sequence(F.lit(0).cast("bigint"), "_last")).alias("_piece"), "_m", "_v")
    return rows.join(pieces, ["_key", "_piece"])


def _animal_sums(rows: DataFrame, post: DataFrame | None, p: int, s: _State) -> DataFrame:
    """Weighted sums per animal: ``_w``, ``_s*``, ``_g*``, and what the degrees of freedom need."""
    z = [F.col(f"_z{i}") for i in range(p)]
    joined = _with_shifts(rows, post) if post is not None else rows.withColumns({
        "_m": F.lit(0.0), "_v": F.lit(float(s.sigma2 * s.ratio))})
    left = _left(z, s.beta, F.lit(1.0)) - F.col("_m")
    distance = (left * left + F.col("_v")) / F.lit(float(s.sigma2))
    nu = F.lit(float(s.nu))
    weighed = joined.withColumn("_d", distance).withColumn("_w", (nu + 1) / (nu + F.col("_d")))
    w, pull = F.col("_w"), F.col("_d") / (nu + F.col("_d"))
    return weighed.groupBy("_key").agg(
        F.max("_piece").alias("_last"),
        F.count(F.lit(1)).alias("_n"),
        F.sum(w).alias("_w"),
        *[F.sum(w * c).alias(f"_s{i}") for i, c in enumerate(z)],
        *[F.sum(w * z[i] * z[j]).alias(f"_g{i}_{j}") for i, j in _pairs(p)],
        F.sum(F.log1p(F.col("_d") / nu)).alias("_logs"),
        F.sum(pull).alias("_pulls"),
        F.sum(pull * pull).alias("_squares"),
    )


@dataclass(frozen=True)
class _Solved:
    """The normal mixed model at one variance ratio: coefficients, residual sum, slope of its criterion."""

    beta: np.ndarray
    rss: float
    slope: float


def _solve(animals: DataFrame, p: int, ratios: Sequence[float]) -> tuple[list[_Solved], tuple]:
    sums = ["_w", *[f"_s{i}" for i in range(p)]]
    t, w = F.col("_t"), F.col("_w")
    shrink, part = t / (1 + t * w), 1 / (1 + t * w)
    pairs = _pairs(p + 1)
    at = animals.withColumn("_t", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    found = at.groupBy("_t").agg(
        F.sum("_n"), F.count(F.lit(1)), F.sum("_logs"), F.sum("_pulls"), F.sum("_squares"),
        F.sum(w * part),
        *[F.sum(c) for c in sums],
        *[F.sum(f"_g{i}_{j}") for i, j in _pairs(p)],
        *[F.sum(shrink * F.col(sums[i]) * F.col(sums[j])) for i, j in pairs],
        *[F.sum(part * part * F.col(sums[i]) * F.col(sums[j])) for i, j in pairs],
    ).collect()
    solved = []
    for row in sorted(found, key=lambda r: list(ratios).index(r[0])):
        values = iter(row[7:])
        gram = np.empty((p + 1, p + 1))
        gram[0] = gram[:, 0] = [next(values) for _ in sums]
        gram[1:, 1:] = _symmetric(p, [next(values) for _ in _pairs(p)])
        weight = gram[0, 0]
        gram = gram - _symmetric(p + 1, [next(values) for _ in pairs])
        change = _symmetric(p + 1, [next(values) for _ in pairs])
        beta = np.linalg.solve(gram[:-1, :-1], gram[:-1, -1])
        c = np.append(-beta, 1.0)
        rss = float(c @ gram @ c)
        slope = -weight * float(c @ change @ c) / rss + row[6]
        solved.append(_Solved(beta, rss / weight, slope))
    return solved, tuple(found[0][1:6])


def _next_ratio(ratio: float, here: _Solved, beside: _Solved) -> float:
    """Secant step in the logarithm of the ratio towards a flat criterion."""
    bend = beside.slope * (1 + RATIO_STEP) - here.slope
    step = -here.slope * math.log1p(RATIO_STEP) / bend if bend > 0 else -math.copysign(1.0, here.slope)
    return ratio * math.exp(max(-1.5, min(1.5, step)))


def _posterior(animals: DataFrame, p: int, s: _State) -> DataFrame:
    shrink = F.lit(float(s.ratio)) / (1 + F.lit(float(s.ratio)) * F.col("_w"))
    own = shrink * _left([F.col(f"_s{i}") for i in range(p)], s.beta, F.col("_w"))
    return animals.select("_key", "_last", own.alias("_m"), (F.lit(float(s.sigma2)) * shrink).alias("_v"))


def student_mixed_fit(
    df: DataFrame,
    response: str,
    predictors: Sequence[str],
    key: str,
    nu: float | None = None,
    max_rounds: int = 80,
    tol: float = 1e-9,
) -> StudentMixedFit:
    """Fit ``response ~ predictors + (1 | key)`` with Student t errors, ``nu`` estimated unless given.

    Rows with a NULL in any column are left out.  ``converged`` tells whether the
    tolerance was met within ``max_rounds``.  A group variance that tends to zero is
    zero; degrees of freedom stay within ``NU_RANGE``, reaching a limit is flagged.
    """
    columns = [*predictors, response]
    complete = require(df.select(key, *columns), [key, *columns])
    m = moments(complete, columns)
    scale = np.sqrt(np.diag(m.cross) / m.n)
    scale[scale == 0] = 1.0
    rows = _laid_out(complete.select(F.col(key).alias("_key"), *[
        ((F.col(c) - F.lit(float(a))) / F.lit(float(b))).alias(f"_z{i}")
        for i, (c, a, b) in enumerate(zip(columns, m.mean, scale, strict=True))]))
    try:
        return _rounds(rows, m, scale, (response, list(predictors), key), nu, max_rounds, tol)
    finally:
        rows.unpersist()


def _rounds(rows: DataFrame, m, scale, names, nu: float | None, max_rounds: int, tol: float) -> StudentMixedFit:
    p = len(scale)
    unit = m.cross / np.outer(scale, scale)
    slopes = np.linalg.solve(unit[:-1, :-1], unit[:-1, -1])
    start = float(unit[-1, -1] - unit[:-1, -1] @ slopes) / m.n
    s = _State(np.append(0.0, slopes), start / 2, 1.0, START_NU if nu is None else nu)
    post, rounds, converged = None, 0, False
    points: list[np.ndarray] = []
    steps: list[np.ndarray] = []
    while rounds < max_rounds and not converged:
        animals = settle(_animal_sums(rows, post, p, s))
        ratios = [s.ratio, s.ratio * (1 + RATIO_STEP)] if s.ratio else [0.0]
        solved, (n, groups, logs, pulls, squares) = _solve(animals, p, ratios)
        new = _State(solved[0].beta, solved[0].rss, s.ratio, s.nu)
        if s.ratio:
            new.ratio = _next_ratio(s.ratio, *solved)
            if new.ratio * n / groups < NO_RATIO:
                new.ratio = 0.0
        if nu is None:
            both = t_scale_step(s.nu, n, logs, pulls, squares)
            if both is not None:
                scaled = s.sigma2 * math.exp(both[0])
                new.ratio, new.sigma2 = new.ratio * new.sigma2 / scaled, scaled
            moved = s.nu * math.exp(both[1] if both is not None else t_degrees_step(s.nu, n, logs, pulls, squares))
            new.nu = min(max(moved, NU_RANGE[0]), NU_RANGE[1])
        each = n / groups
        moves = new.vector(each) - s.vector(each)
        if (new.ratio == 0) != (s.ratio == 0):
            points, steps = [], []
        points.append(s.vector(each))
        steps.append(moves)
        converged = bool(np.max(np.abs(moves)) < tol)
        s, rounds = _State.of(_accelerated(points, steps), each, new, nu is None), rounds + 1
        post = _posterior(animals, p, s)
    return _finished(rows, animals, post, s, m, scale, names, rounds, converged)


def _finished(rows, animals, post, s: _State, m, scale, names, rounds: int, converged: bool) -> StudentMixedFit:
    response, predictors, key = names
    p = len(predictors) + 1
    z = [F.col(f"_z{i}") for i in range(p - 1)]
    # Expected information: every row weighs as much as t errors let it on average.
    weight = (s.nu + 1) / (s.nu + 3)
    plain = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_z"), *[F.sum(c).alias(f"_z{i}") for i, c in enumerate(z)])
    each = [F.col("_z"), *z]
    shrink = F.lit(weight * s.ratio) / (1 + F.lit(weight * s.ratio) * F.col("_z"))
    row = plain.agg(*[F.sum(shrink * each[i] * each[j]) for i, j in _pairs(p)]).first()
    flat = np.zeros((p, p))
    flat[0, 0] = m.n
    flat[1:, 1:] = m.cross[:-1, :-1] / np.outer(scale[:-1], scale[:-1])
    cov = s.sigma2 / weight * np.linalg.inv(flat - _symmetric(p, row))
    back = np.eye(p)
    back[1:, 1:] = np.diag(1 / scale[:-1])
    back[0, 1:] = -m.mean[:-1] / scale[:-1]
    back *= scale[-1]
    coef = back @ s.beta
    coef[0] += m.mean[-1]

    lean = F.lit(float(s.ratio)) / (1 + F.lit(float(s.ratio)) * F.col("_w"))
    known = settle(animals.join(post.drop("_last"), "_key").select(
        F.col("_key").alias(key), F.col("_n").alias("n"), F.array("_m").alias("shifts"),
        F.array(*[lean * F.col(c) for c in ("_w", *[f"_s{i}" for i in range(p - 1)])]).alias("lean"),
        F.array("_v").alias("spread")))
    objective = _objective(rows, post, p, s)
    return StudentMixedFit(
        response, predictors, key, coef, back @ cov @ back.T, float(math.sqrt(s.sigma2) * scale[-1]),
        float(math.sqrt(s.sigma2 * s.ratio) * scale[-1]), float(s.nu), s.nu in NU_RANGE,
        objective - m.n * math.log(scale[-1]), rounds, converged, m.n,
        Conditional(predictors, key, m.mean[:-1], scale[:-1], float(m.mean[-1]), float(scale[-1]), s.beta, cov, [0], known))


def _objective(rows: DataFrame, post: DataFrame, p: int, s: _State) -> float:
    left = _left([F.col(f"_z{i}") for i in range(p)], s.beta, F.lit(1.0)) - F.col("_m")
    distance = (left * left + F.col("_v")) / F.lit(float(s.sigma2))
    n, logs = _with_shifts(rows, post).agg(F.count(F.lit(1)), F.sum(F.log1p(distance / F.lit(float(s.nu))))).first()
    each = math.lgamma((s.nu + 1) / 2) - math.lgamma(s.nu / 2) - math.log(s.nu * math.pi * s.sigma2) / 2
    total = n * each - (s.nu + 1) / 2 * logs
    if s.ratio:
        tau2 = s.sigma2 * s.ratio
        m, v = F.col("_m"), F.col("_v")
        total += post.agg(F.sum(1 + F.log(v / F.lit(tau2)) - (m * m + v) / F.lit(tau2))).first()[0] / 2
    return float(total)


def student_effects(fit: StudentMixedFit, name: str = "effect") -> DataFrame:
    """Expected intercept shift of each animal and its standard deviation."""
    unit = F.lit(fit.conditional.unit)
    return fit.conditional.animals.select(
        fit.key, "n", (unit * F.col("shifts")[0]).alias(name), (unit * F.sqrt(F.col("spread")[0])).alias("sd"))
