"""Telemetry preparation: exported tables per animal, matched samples, environment values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.timeconv import serial_to_minute
from driftline.operators.joins import box_columns, box_extract
from driftline.operators.windows import first_per_day
from driftline.plans.study import DRIFT_DIVE_TYPE

# Exported columns of the dive table.
DIVE_TYPE_COLUMNS = ("SealID", "DiveNumber", "DriftRate", "DiveType", "DiveTypeName")


def drift_dives(dive_type: DataFrame) -> DataFrame:
    return dive_type.where(F.col("DiveType") == DRIFT_DIVE_TYPE).select(*DIVE_TYPE_COLUMNS)


def environment_at_tags(tags: DataFrame, grid: DataFrame, products: Sequence[str]) -> DataFrame:
    """First position of each tag and day with the box statistics of every product.

    ``tags``: ptt, lat, lon, serial (day number), fpt.  ``grid``: product, time (date),
    lat, lon, value.
    """
    timed = tags.withColumn("dt", serial_to_minute(F.col("serial"))).withColumn("time", F.to_date("dt"))
    order = [F.col(c) for c in ("serial", "lat", "lon")]
    daily = first_per_day(timed, "ptt", "time", order, ["dt", "lat", "lon", "fpt"])
    keyed = daily.withColumn("point", F.struct("ptt", "time"))
    values = box_columns(box_extract(keyed, grid, "point"), "point", products)
    return keyed.join(values, "point", "left").drop("point")
