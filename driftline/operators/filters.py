"""Row filters, id overrides and composite keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.scalars import display_key


def exclude_ids(df: DataFrame, key: str, ids: Sequence[str]) -> DataFrame:
    """Drop listed ids; a NULL id is dropped too."""
    return df.where(~F.col(key).isin(list(ids)))


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep rows where every listed column is present (complete cases)."""
    return df.na.drop(subset=list(columns))


def nan_as_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating-point column."""
    floats = {n for n, t in df.dtypes if t in ("double", "float")}
    return df.select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns]
    )


def with_moments(df: DataFrame, columns: Sequence[str], into: str = "_moments") -> DataFrame:
    """Attach mean and sample SD of whole columns as one uncorrelated scalar subquery."""
    parts = [F.avg(c).alias(f"{c}_mean") for c in columns]
    parts += [F.stddev_samp(c).alias(f"{c}_sd") for c in columns]
    moments = df.agg(F.struct(*parts).alias("m"))
    return df.withColumn(into, moments.scalar())


def within_sigma(df: DataFrame, column: str, k: float = 3.0) -> DataFrame:
    """Keep rows within ``k`` SD of the mean over all animals, limits included."""
    centre, spread = F.col(f"_moments.{column}_mean"), F.col(f"_moments.{column}_sd")
    kept = with_moments(df, [column]).where(F.abs(F.col(column) - centre) <= k * spread)
    return kept.drop("_moments")


def standardise(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add z-scores over the whole table; ``columns`` maps source to output name."""
    scored = with_moments(df, list(columns))
    for source, name in columns.items():
        centre, spread = F.col(f"_moments.{source}_mean"), F.col(f"_moments.{source}_sd")
        scored = scored.withColumn(name, F.try_divide(F.col(source) - centre, spread))
    return scored.drop("_moments")


def add_day_key(df: DataFrame, key: str, day: str, name: str = "seal_date") -> DataFrame:
    return df.withColumn(name, display_key(F.col(key), F.col(day)))


def key_prefix(key: Column, length: int = 3) -> Column:
    """First characters of a display key.  Distinct ids can share a prefix; group by the id."""
    return F.substring(key, 1, length)
