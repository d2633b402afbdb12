"""Prediction grids and wide-to-long reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand_grid(base: DataFrame, axes: Mapping[str, Sequence[object]]) -> DataFrame:
    """Every row of ``base`` combined with every value of the short literal ``axes``."""
    grid = base
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return grid


def levels(df: DataFrame, column: str, limit: int = 1000) -> list:
    """Sorted distinct values of a category; raises beyond ``limit`` values."""
    found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} levels")
    return sorted(r[0] for r in found)


def distinct_axis(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct()


def dummies(df: DataFrame, column: str, values: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """0/1 columns for every level but the first; NULL stays NULL."""
    names = [f"{column}_{v}" for v in values[1:]]
    flags = {n: (F.col(column) == v).cast("double") for n, v in zip(names, values[1:])}
    return df.withColumns(flags), names


def draws_to_long(wide: DataFrame, ids: Sequence[str], draws: Sequence[str], value: str) -> DataFrame:
    return wide.unpivot(list(ids), list(draws), "draw", value)
