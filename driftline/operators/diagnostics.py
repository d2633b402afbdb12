"""Residual checks: serial correlation, normality, density and quantile pairs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.distributions import chi2_tail
from driftline.functions.scalars import normal_quantile, plotting_position
from driftline.operators.quantiles import group_quantiles
from driftline.operators.skew import number_rows, with_neighbours


def durbin_watson(df: DataFrame, keys: Sequence[str], order: Sequence[Column], residual: str) -> DataFrame:
    """Sum of squared steps over sum of squares, per animal in time order."""
    stepped = with_neighbours(df, keys, order, residual, [-1], "_e")
    step = F.col(residual) - F.col("_e-1")
    return stepped.groupBy(*keys).agg(
        F.count(residual).alias("n"),
        F.try_divide(F.sum(step * step), F.sum(F.col(residual) * F.col(residual))).alias("dw"),
    )


def autocorrelation(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], column: str, lags: int
) -> DataFrame:
    """Autocorrelations at lags 1..``lags`` per group, one row per lag (biased denominator)."""
    shifted = with_neighbours(df, keys, order, column, [-k for k in range(1, lags + 1)], "_e")
    # Lagged products about the mean expand into plain sums, so one pass suffices
    # once the column is shifted near its mean by the overall average.
    origin = df.agg(F.avg(column)).scalar()
    x = shifted.withColumn("_o", origin).select(
        *keys,
        (F.col(column) - F.col("_o")).alias("_x"),
        *[(F.col(f"_e-{k}") - F.col("_o")).alias(f"_x{k}") for k in range(1, lags + 1)],
    )
    sums = x.groupBy(*keys).agg(
        F.count("_x").alias("n"),
        F.avg("_x").alias("_m"),
        F.var_pop("_x").alias("_v"),
        *[F.sum(F.col("_x") * F.col(f"_x{k}")).alias(f"_p{k}") for k in range(1, lags + 1)],
        *[F.sum(F.when(F.col(f"_x{k}").isNotNull(), F.col("_x"))).alias(f"_a{k}") for k in range(1, lags + 1)],
        *[F.sum(F.when(F.col("_x").isNotNull(), F.col(f"_x{k}"))).alias(f"_b{k}") for k in range(1, lags + 1)],
        *[
            F.count_if(F.col("_x").isNotNull() & F.col(f"_x{k}").isNotNull()).alias(f"_c{k}")
            for k in range(1, lags + 1)
        ],
    )
    m = F.col("_m")
    each = F.array(
        *[
            F.struct(
                F.lit(k).cast("bigint").alias("lag"),
                F.try_divide(
                    F.col(f"_p{k}") - m * (F.col(f"_a{k}") + F.col(f"_b{k}")) + m * m * F.col(f"_c{k}"),
                    F.col("n") * F.col("_v"),
                ).alias("acf"),
            )
            for k in range(1, lags + 1)
        ]
    )
    return sums.select(*keys, "n", F.inline(each))


def partial_autocorrelation(acf: Sequence[float]) -> list[float]:
    """Durbin-Levinson recursion on a short list of autocorrelations."""
    partial: list[float] = []
    phi = np.zeros(0)
    for k, r in enumerate(acf, start=1):
        if k == 1:
            last, phi = r, np.array([r])
        else:
            earlier = np.array(acf[: k - 1])
            last = (r - phi @ earlier[::-1]) / (1 - phi @ earlier)
            phi = np.append(phi - last * phi[::-1], last)
        partial.append(float(last))
    return partial


def pacf(df: DataFrame, order: Sequence[Column], column: str, lags: int) -> list[float]:
    """Partial autocorrelations of one ordered series (``lags`` numbers reach the driver)."""
    rows = autocorrelation(df, [], order, column, lags).collect()
    return partial_autocorrelation([r["acf"] for r in sorted(rows, key=lambda r: r["lag"])])


def qq_pairs(df: DataFrame, keys: Sequence[str], column: str, tie: Sequence[str]) -> DataFrame:
    """Ordered values against normal quantiles, per group or over the whole table."""
    order = [F.col(column).asc(), *[F.col(t).asc() for t in tie]]
    numbered = number_rows(df.where(F.col(column).isNotNull()), keys, order, "rank", "n")
    return numbered.withColumn("theoretical", normal_quantile(plotting_position(F.col("rank"), F.col("n"))))


def qq_line(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Line through the first and third quartiles of values and of the normal distribution."""
    quartiles = group_quantiles(df, keys, {"q1": (column, 0.25), "q3": (column, 0.75)})
    low, high = normal_quantile(F.lit(0.25)), normal_quantile(F.lit(0.75))
    return quartiles.withColumn("slope", (F.col("q3") - F.col("q1")) / (high - low)).withColumn(
        "intercept", F.col("q1") - F.col("slope") * low
    )


def jarque_bera(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Skewness, excess kurtosis and the Jarque-Bera statistic (population moments)."""
    shape = df.groupBy(*keys).agg(
        F.count(column).alias("n"), F.skewness(column).alias("skewness"), F.kurtosis(column).alias("kurtosis")
    )
    s, k = F.col("skewness"), F.col("kurtosis")
    return shape.withColumn("jb", F.col("n") / 6 * (s * s + k * k / 4))


# Royston's approximations (1995), coefficients of rising powers.
OUTER_WEIGHT = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
NEXT_WEIGHT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_LIMIT = (-2.273, 0.459)
SMALL_MEAN = (0.5440, -0.39978, 0.025054, -0.0006714)
SMALL_SPREAD = (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LARGE_SPREAD = (-0.4803, -0.082676, 0.0030302)
SMALL_ROWS = 11  # the first approximation holds up to here
TWO_OUTER = 6  # from here on two weights at each end are set apart


def _rising(coefficients: Sequence[float], x: Column) -> Column:
    value = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        value = value * x + F.lit(float(c))
    return value


def shapiro_wilk(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Shapiro-Wilk's W and its probability per group, for any number of rows from three on.

    Values are ranked across range slices and meet their normal scores as an expression;
    one aggregate follows, so no group is gathered.  NULL values are left out.  Fewer than
    three rows and groups of one value give NULL.  The probability was calibrated for up
    to 5000 rows and is the same formula beyond.
    """
    ranked = number_rows(df.where(F.col(column).isNotNull()), keys, [F.col(column).asc()], "_rank", "_n")
    score = normal_quantile((F.col("_rank") - 0.375) / (F.col("_n") + 0.25))
    placed = ranked.select(*keys, F.col(column).alias("_x"), "_rank", "_n", score.alias("_score"))
    at = lambda rank, what: F.max(F.when(F.col("_rank") == rank, F.col(what)))
    n = F.col("_n")
    sums = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("_score") * F.col("_score")).alias("_mm"),
        F.sum(F.col("_score") * F.col("_x")).alias("_mx"),
        (F.var_pop("_x") * F.count(F.lit(1))).alias("_ss"),
        (at(n, "_x") - at(F.lit(1), "_x")).alias("_outer"),
        (at(n - 1, "_x") - at(F.lit(2), "_x")).alias("_next"),
        at(n, "_score").alias("_m1"),
        at(n - 1, "_score").alias("_m2"),
    )
    n, mm, m1, m2 = (F.col(c) for c in ("n", "_mm", "_m1", "_m2"))
    two, root = n >= TWO_OUTER, 1 / F.sqrt(n)
    length = F.sqrt(mm)
    a1 = F.when(n == 3, F.sqrt(F.lit(0.5))).otherwise(_rising(OUTER_WEIGHT, root) + F.try_divide(m1, length))
    a2 = F.when(two, _rising(NEXT_WEIGHT, root) + F.try_divide(m2, length))
    inner = F.when(
        two, F.try_divide(mm - 2 * m1 * m1 - 2 * m2 * m2, 1 - 2 * F.col("_a1") * F.col("_a1") - 2 * F.col("_a2") * F.col("_a2"))
    ).when(n > 3, F.try_divide(mm - 2 * m1 * m1, 1 - 2 * F.col("_a1") * F.col("_a1")))
    middle = F.col("_mx") - m1 * F.col("_outer") - F.when(two, m2 * F.col("_next")).otherwise(0.0)
    total = F.col("_a1") * F.col("_outer") + F.when(two, F.col("_a2") * F.col("_next")).otherwise(0.0)
    total = total + F.when(n > 3, F.try_divide(middle, F.sqrt("_inner"))).otherwise(0.0)
    weighed = sums.withColumns({"_a1": a1, "_a2": a2}).withColumn("_inner", inner)
    tested = weighed.withColumn("w", F.when((n >= 3) & (F.col("_ss") > 0), F.least(F.try_divide(total * total, F.col("_ss")), F.lit(1.0))))

    w, logged = F.col("w"), F.ln(n)
    off = F.ln(1 - w)
    bent = -F.ln(_rising(SMALL_LIMIT, n) - off)
    small = (bent - _rising(SMALL_MEAN, n)) / F.exp(_rising(SMALL_SPREAD, n))
    large = (off - _rising(LARGE_MEAN, logged)) / F.exp(_rising(LARGE_SPREAD, logged))
    z = tested.withColumn("_z", F.when(n <= SMALL_ROWS, small).otherwise(large))
    beyond = chi2_tail(F.col("_z") * F.col("_z"), F.lit(1)) / 2
    normal = F.when(F.col("_z") >= 0, beyond).otherwise(1 - beyond)
    three = F.greatest(F.lit(6 / np.pi) * (F.asin(F.sqrt(w)) - F.asin(F.sqrt(F.lit(0.75)))), F.lit(0.0))
    sure = F.when(w == 1, 1.0).when((n > 3) & (n <= SMALL_ROWS) & (_rising(SMALL_LIMIT, n) <= off), 0.0)
    chance = F.when(n == 3, three).otherwise(F.coalesce(sure, normal))
    return z.select(*keys, "n", "w", F.when(w.isNotNull(), chance).alias("p_value"))


# Default bandwidth rule and margins of the density estimate.
BANDWIDTH_FACTOR = 0.9
IQR_TO_SD = 1.34
CUT = 3
MASS_MARGIN = 4


def kde(df: DataFrame, column: str, points: int = 512) -> DataFrame:
    """Gaussian kernel density at ``points`` places.

    Rows are spread onto a fine fixed grid by linear binning (one mergeable
    aggregate); only the binned mass meets the kernel, so work after the scan
    does not depend on the number of rows.
    """
    facts = group_quantiles(
        df,
        [],
        {"q1": (column, 0.25), "q3": (column, 0.75)},
        {"n": (column, "count"), "lo": (column, "min"), "hi": (column, "max")},
    ).first()
    sd = df.agg(F.stddev_samp(column)).first()[0]
    n, iqr = facts["n"], facts["q3"] - facts["q1"]
    spread = min(sd, iqr / IQR_TO_SD) or sd or abs(facts["lo"]) or 1.0
    width = BANDWIDTH_FACTOR * spread * n**-0.2
    bins = 2 * points
    low = facts["lo"] - (CUT + MASS_MARGIN) * width
    step = (facts["hi"] + (CUT + MASS_MARGIN) * width - low) / (bins - 1)
    place = (F.col(column) - F.lit(low)) / F.lit(step)
    left = F.floor(place)
    shares = F.array(
        F.struct(left.alias("bin"), (1 - (place - left)).alias("w")),
        F.struct((left + 1).alias("bin"), (place - left).alias("w")),
    )
    mass = (
        df.where(F.col(column).isNotNull())
        .select(F.inline(shares))
        .groupBy("bin")
        .agg((F.sum("w") / n).alias("mass"))
    )
    start = facts["lo"] - CUT * width
    stride = (facts["hi"] + CUT * width - start) / (points - 1)
    centre = F.lit(low) + F.col("bin") * F.lit(step)
    x = F.lit(start) + F.col("point") * F.lit(stride)
    u = (x - centre) / F.lit(width)
    bell = F.exp(-u * u / 2) / F.lit(width * float(np.sqrt(2 * np.pi)))
    return (
        mass.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", x)
        .groupBy(F.col("point").cast("bigint").alias("point"))
        .agg(F.first("x").alias("x"), F.sum(F.col("mass") * bell).alias("density"))
    )
