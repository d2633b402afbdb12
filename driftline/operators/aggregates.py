"""Daily positions, trip scalars, histograms, box statistics and analysis of variance."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.distributions import f_tail
from driftline.operators.filters import with_moments
from driftline.operators.quantiles import group_quantiles

# Interval of a prediction summary.
LOWER_P = 0.025
UPPER_P = 0.975
WHISKER_IQR = 1.5


def daily_position(df: DataFrame, key: str, day: str, columns: dict[str, str]) -> DataFrame:
    """Exact median of each axis per animal and day, of any size; ``columns`` maps source to output."""
    return group_quantiles(df, [key, day], {name: (c, 0.5) for c, name in columns.items()})


def daily_mean(df: DataFrame, key: str, day: str, column: str, name: str) -> DataFrame:
    return df.groupBy(key, day).agg(F.avg(column).alias(name))


def draw_summary(
    draws: DataFrame, keys: Sequence[str], value: str, name: str | None = None, approximate: bool = False
) -> DataFrame:
    """Mean and 95 % limits of draws per key."""
    name = name or value
    return group_quantiles(
        draws,
        keys,
        {f"{name}_lwr": (value, LOWER_P), f"{name}_upr": (value, UPPER_P)},
        {name: (value, "mean")},
        approximate,
    )


def outer_quantiles(df: DataFrame, column: str) -> DataFrame:
    return group_quantiles(df, [], {f"{column}_lwr": (column, LOWER_P), f"{column}_upr": (column, UPPER_P)})


def trip_scalars(df: DataFrame, key: str, day: str, drift: str) -> DataFrame:
    """Mean and sum of drift and the earliest day of its maximum."""
    peak = F.max_by(F.col(day), F.struct(F.col(drift), -F.unix_date(day)))
    return df.groupBy(key).agg(
        F.avg(drift).alias("drift_mean"), F.sum(drift).alias("drift_sum"), peak.alias("drift_max_day")
    )


def bounding_box(df: DataFrame, keys: Sequence[str], lat: str, lon: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min(lat).alias("lat_min"),
        F.max(lat).alias("lat_max"),
        F.min(lon).alias("lon_min"),
        F.max(lon).alias("lon_max"),
    )


def trip_extremes(df: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    return df.groupBy(key).agg(F.max(lat).alias("max_lat"), F.min(lon).alias("min_lon"))


def mass_change(df: DataFrame, before: str, after: str, name: str = "mass_change") -> DataFrame:
    return df.withColumn(name, F.col(after) - F.col(before))


# Fixed value: a value this part of a class width beyond a break counts as on it.
BREAK_SLACK = 1e-7


def pretty_breaks(low: float, high: float, classes: int) -> tuple[int, float, int]:
    """First break as a multiple of the class width, the width, and the number of classes.

    The breaks are round numbers that cover [low, high] in about ``classes`` steps.
    """
    spread = high - low
    cell = spread / classes if spread > 0 else max(abs(low), 1.0) / classes
    base = 10.0 ** math.floor(math.log10(cell))
    unit = base
    # 2, 5 and 10 are preferred by these bias factors.
    for factor, bias in ((2, 1.5), (5, 2.75), (10, 1.5)):
        if factor * base - cell < bias * (cell - unit):
            unit = factor * base
        else:
            break
    first = math.floor(low / unit + BREAK_SLACK)
    last = math.ceil(high / unit - BREAK_SLACK)
    return first, unit, max(last - first, 1)


def _counted_classes(df: DataFrame, class_no: Column, numbers: range) -> DataFrame:
    counted = df.groupBy(class_no.cast("bigint").alias("class_no")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(numbers.start, numbers.stop).select(F.col("id").alias("class_no"))
    return every.join(counted, "class_no", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def histogram(df: DataFrame, column: str, classes: int | None = None) -> DataFrame:
    """Counts per right-closed class, the lowest limit included; they add up to the non-NULL rows.

    By default the number of classes follows from the row count and the limits
    are rounded; empty classes are listed with a zero count.
    """
    n, low, high = df.agg(F.count(column), F.min(column), F.max(column)).first()
    if not n:
        return df.sparkSession.createDataFrame([], "class_no bigint, class_low double, class_high double, n bigint")
    first, unit, count = pretty_breaks(low, high, classes or math.ceil(math.log2(n) + 1))
    place = F.ceil(F.col(column) / F.lit(unit) - BREAK_SLACK) - first
    class_no = F.greatest(F.lit(1), F.least(F.lit(count), place))
    found = _counted_classes(df.where(F.col(column).isNotNull()), class_no, range(1, count + 1))
    edge = lambda k: (F.col("class_no") + (first + k)) * F.lit(unit)
    return found.select("class_no", edge(-1).alias("class_low"), edge(0).alias("class_high"), "n")


def fixed_histogram(df: DataFrame, column: str, start: float, width: float, classes: int) -> DataFrame:
    """Counts per class of given limits; class 0 holds values below them, ``classes`` + 1 those above."""
    place = (F.col(column) - F.lit(start)) / F.lit(width)
    class_no = (
        F.when(F.abs(place) <= BREAK_SLACK, 1)
        .when(place < 0, 0)
        .otherwise(F.least(F.lit(classes + 1), F.ceil(place - BREAK_SLACK)))
    )
    found = _counted_classes(df.where(F.col(column).isNotNull()), class_no, range(classes + 2))
    edge = lambda k: F.lit(start) + (F.col("class_no") + k) * F.lit(width)
    return found.select(
        "class_no",
        F.when(F.col("class_no") > 0, edge(-1)).alias("class_low"),
        F.when(F.col("class_no") <= classes, edge(0)).alias("class_high"),
        "n",
    )


def _box_limits(df: DataFrame, key: str, column: str) -> DataFrame:
    quartiles = group_quantiles(
        df,
        [key],
        {"q1": (column, 0.25), "median": (column, 0.5), "q3": (column, 0.75)},
        {"n": (column, "count")},
    )
    reach = WHISKER_IQR * (F.col("q3") - F.col("q1"))
    return quartiles.withColumn("_low", F.col("q1") - reach).withColumn("_high", F.col("q3") + reach)


def box_stats(df: DataFrame, key: str, column: str) -> DataFrame:
    """Quartiles, whiskers at the furthest points within 1.5 IQR, and outlier counts."""
    limits = _box_limits(df, key, column)
    inside = F.col(column).between(F.col("_low"), F.col("_high"))
    facts = ["n", "q1", "median", "q3"]
    return (
        df.select(key, column)
        .join(limits, key)
        .groupBy(key)
        .agg(
            *[F.first(c).alias(c) for c in facts],
            F.min(F.when(inside, F.col(column))).alias("whisker_low"),
            F.max(F.when(inside, F.col(column))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def box_outliers(df: DataFrame, key: str, column: str) -> DataFrame:
    limits = _box_limits(df, key, column).select(key, "_low", "_high")
    return df.join(limits, key).where(~F.col(column).between(F.col("_low"), F.col("_high"))).drop("_low", "_high")


def one_way_anova(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row per response: sums of squares, degrees of freedom, F and the probability of a larger one."""
    # Responses are centred first so that the between-group sum keeps its digits.
    centred = with_moments(df, columns).select(
        key, *[(F.col(c) - F.col(f"_moments.{c}_mean")).alias(c) for c in columns]
    )
    long = centred.unpivot(key, list(columns), "response", "_y")
    long = long.where(F.col("_y").isNotNull() & F.col(key).isNotNull())
    groups = long.groupBy("response", key).agg(
        F.count("_y").alias("_n"), F.avg("_y").alias("_m"), F.var_pop("_y").alias("_v")
    )
    totals = groups.groupBy("response").agg(
        F.sum("_n").alias("n"),
        F.count(F.lit(1)).alias("groups"),
        F.sum(F.col("_n") * F.col("_v")).alias("ss_within"),
        F.sum(F.col("_n") * F.col("_m")).alias("_nm"),
        F.sum(F.col("_n") * F.col("_m") * F.col("_m")).alias("_nmm"),
    )
    between = F.col("_nmm") - F.col("_nm") * F.col("_nm") / F.col("n")
    df_between = (F.col("groups") - 1).cast("bigint")
    df_within = (F.col("n") - F.col("groups")).cast("bigint")
    return totals.select(
        "response",
        df_between.alias("df_between"),
        df_within.alias("df_within"),
        between.alias("ss_between"),
        "ss_within",
        F.try_divide(between / df_between, F.col("ss_within") / df_within).alias("f_value"),
    ).withColumn("p_value", f_tail(F.col("f_value"), F.col("df_between"), F.col("df_within")))


