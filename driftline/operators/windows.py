"""Per-animal windows over calendar days and over rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.operators.skew import number_rows


def trailing_day_mean(
    df: DataFrame, key: str, day: str, columns: dict[str, str], days: int = 7
) -> DataFrame:
    """Mean over rows of the animal dated in [d - days + 1, d], same-day rows included.

    Rows are first summed to one row per animal and day, so the window is
    bounded by the calendar and not by the number of fixes of an animal.
    """
    sums = [F.sum(c).alias(f"_s_{c}") for c in columns]
    counts = [F.count(c).alias(f"_c_{c}") for c in columns]
    daily = df.where(F.col(day).isNotNull()).groupBy(key, day).agg(*sums, *counts)
    recent = Window.partitionBy(key).orderBy(F.unix_date(day)).rangeBetween(-(days - 1), 0)
    means = daily.select(
        key,
        day,
        *[
            F.try_divide(F.sum(f"_s_{c}").over(recent), F.sum(f"_c_{c}").over(recent)).alias(name)
            for c, name in columns.items()
        ],
    )
    return df.join(means, [key, day], "left")


def centred_row_mean(
    daily: DataFrame, key: str, day: str, column: str, name: str, width: int = 5
) -> DataFrame:
    """Centred mean over ``width`` observed days; NULL where the frame is not full.

    ``daily`` holds at most one row per animal and day.
    """
    half = width // 2
    frame = (
        Window.partitionBy(key).orderBy(F.col(day).asc_nulls_last()).rowsBetween(-half, half)
    )
    full = F.count(column).over(frame) == width
    return daily.withColumn(name, F.when(full, F.avg(column).over(frame)))


def centred_day_mean(
    daily: DataFrame, key: str, day: str, column: str, name: str, width: int = 5
) -> DataFrame:
    """The calendar variant of :func:`centred_row_mean`: days [d - w/2, d + w/2] that exist."""
    half = width // 2
    frame = Window.partitionBy(key).orderBy(F.unix_date(day)).rangeBetween(-half, half)
    return daily.withColumn(name, F.avg(column).over(frame))


def day_index(df: DataFrame, key: str, day: str, name: str = "day_index") -> DataFrame:
    """Number the observed days of each animal from 1."""
    days = df.select(key, day).distinct()
    return days.withColumn(
        name, F.row_number().over(Window.partitionBy(key).orderBy(F.col(day).asc_nulls_last())).cast("bigint")
    )


def first_per_day(
    df: DataFrame, key: str, day: str, order: Sequence[Column], columns: Sequence[str]
) -> DataFrame:
    """First fix of each animal and day in the given total order, as a mergeable aggregate."""
    first = F.min_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(key, day).agg(first.alias("_f")).select(key, day, "_f.*")


def stride_sample(
    df: DataFrame, key: str, order: Sequence[Column], target: int = 40
) -> DataFrame:
    """Rows 1, 1+s, 1+2s, ... of each track with s = round(n / target), at least 1."""
    numbered = number_rows(df, [key], order, "_row", "_rows")
    stride = F.greatest(F.lit(1), F.round(F.col("_rows") / target).cast("bigint"))
    return (
        numbered.withColumn("stride", stride)
        .where((F.col("_row") - 1) % F.col("stride") == 0)
        .drop("_row", "_rows")
    )


def ordered_series(df: DataFrame, key: str, day: str, columns: Sequence[str]) -> DataFrame:
    """Per-animal series in date order, missing dates last (a global range sort)."""
    return df.select(key, day, *columns).orderBy(
        F.col(key).asc_nulls_last(), F.col(day).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in columns]
    )
