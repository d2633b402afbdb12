"""Fixed values of the study: exclusions, known dates and overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Ids dropped before dating, ids whose deployment date is known
# although their whisker was not a regrown one, and animals with one measured
# length (cm) at a known day (days since 1970-01-01).
EXCLUDED_IDS = ("X822", "5430", "X 58", "5055", "B 66", "9838", "7019")
KNOWN_START_IDS = ("7019", "PM695")
OVERRIDES = (("6564", 17653.0, 7.86),)
DRIFT_DIVE_TYPE = 2


def overrides_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(OVERRIDES), "seal_id string, known_day double, known_length double")
