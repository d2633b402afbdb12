"""From raw segments, tracks and dives to the table the models are fitted to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions import growth as g
from driftline.functions.scalars import unwrap_longitude
from driftline.functions.timeconv import day_to_date, date_to_days, parse_us_date, serial_to_date
from driftline.operators.aggregates import daily_mean, daily_position
from driftline.operators.filters import exclude_ids, require, within_sigma
from driftline.operators.joins import day_join, lookup, natural_join, two_key_join
from driftline.operators.windows import centred_row_mean, trailing_day_mean
from driftline.plans.study import DRIFT_DIVE_TYPE, EXCLUDED_IDS, KNOWN_START_IDS

# Names in the isotope file.
ISOTOPE_SCHEMA = (
    "SealID string, Segment int, d13C double, d15N double, LengthRecovery double, RecoveryDate string, "
    "DeploymentDate string, WhiskerColumn int, WhiskerRow int, Nubbin string, DistanceFromTip double, "
    "Comments string, Weighter string, Lat double, Lon double"
)


def tidy_isotopes(raw: DataFrame) -> DataFrame:
    """Rename, parse the text dates to day numbers and drop what is not used."""
    return raw.select(
        F.col("SealID").alias("seal_id"),
        F.col("Segment").alias("segment"),
        F.col("d13C").alias("d13c"),
        F.col("d15N").alias("d15n"),
        F.col("LengthRecovery").alias("length_recovery"),
        date_to_days(parse_us_date(F.col("RecoveryDate"))).alias("recovery_days"),
        date_to_days(parse_us_date(F.col("DeploymentDate"))).alias("deployment_days"),
        F.col("WhiskerColumn").alias("whisker_column"),
        F.col("WhiskerRow").alias("whisker_row"),
        (F.col("Nubbin") == "yes").alias("nubbin"),
        F.col("DistanceFromTip").alias("distance_from_tip"),
    )


def date_segments(
    segments: DataFrame, known_start_ids: Sequence[str] = KNOWN_START_IDS, offset: float = g.LENGTH_OFFSET
) -> DataFrame:
    """Add asymptote, start of growth, rate, segment day and duration to each segment."""
    linf, length, recovery = F.col("linf"), F.col("length_recovery"), F.col("recovery_days")
    known = F.col("nubbin") | F.col("seal_id").isin(list(known_start_ids))
    solved = g.growth_start(linf, length, recovery, offset)
    start = F.when(known, F.col("deployment_days")).when(~known, solved)
    dated = (
        segments.withColumn("linf", g.asymptotic_length(F.col("whisker_column"), F.col("whisker_row")))
        .withColumn("deployment_days", start)
        .withColumn("k", g.realised_rate(linf, length, recovery, F.col("deployment_days"), offset))
        .withColumn(
            "segment_days",
            g.segment_day(
                F.col("distance_from_tip"), g.effective_asymptote(linf, length), F.col("k"), F.col("deployment_days")
            ),
        )
    )
    return _finish_dates(dated)


def _finish_dates(df: DataFrame) -> DataFrame:
    return df.withColumn("deployment_duration", F.col("recovery_days") - F.col("deployment_days")).withColumn(
        "segment_date", day_to_date(F.col("segment_days"))
    )


def apply_overrides(dated: DataFrame, overrides: DataFrame) -> DataFrame:
    """Redate animals with one measured length at a known day.

    ``overrides`` (seal_id, known_day, known_length) has one row per animal.
    The segment date, and so every later join key, follows the new dates.
    """
    joined = lookup(dated, overrides, "seal_id")
    changed = F.col("known_day").isNotNull()
    length = F.col("length_recovery")
    start = g.start_from_known_length(length, F.col("known_length"), F.col("known_day"))
    redated = (
        joined.withColumn("deployment_days", F.when(changed, start).otherwise(F.col("deployment_days")))
        .withColumn("k", F.when(changed, g.growth_rate(length)).otherwise(F.col("k")))
        .withColumn(
            "segment_days",
            F.when(
                changed,
                g.segment_day(F.col("distance_from_tip"), length, F.col("k"), F.col("deployment_days")),
            ).otherwise(F.col("segment_days")),
        )
    )
    return _finish_dates(redated).drop("known_day", "known_length")


def daily_track(track: DataFrame, unwrap_first: bool = False) -> DataFrame:
    """One median position per animal and day from fixes with a serial day number."""
    fixes = track.select("seal_id", serial_to_date(F.col("jul_date")).alias("segment_date"), "lat", "lon")
    if unwrap_first:
        fixes = fixes.withColumn("lon", unwrap_longitude(F.col("lon")))
    return daily_position(fixes, "seal_id", "segment_date", {"lat": "lat", "lon": "lon"})


def daily_drift(dive_type: DataFrame, dive_stat: DataFrame) -> DataFrame:
    """Mean drift rate per animal and day without outliers, and its five-row mean.

    ``dive_stat`` has one row per animal and dive number.
    """
    drift = dive_type.where(F.col("dive_type") == DRIFT_DIVE_TYPE).select("seal_id", "dive_number", "drift_rate")
    # One time per dive, so the filter and its moments can come before the join.
    kept = within_sigma(drift, "drift_rate", 3.0)
    timed = two_key_join(kept, dive_stat.select("seal_id", "dive_number", "jul_date"), ["seal_id", "dive_number"])
    dated = timed.withColumn("segment_date", serial_to_date(F.col("jul_date")))
    daily = daily_mean(dated, "seal_id", "segment_date", "drift_rate", "drift_rate")
    return centred_row_mean(daily, "seal_id", "segment_date", "drift_rate", "five_day_drift")


def prepare_segments(isotopes: DataFrame, overrides: DataFrame, excluded: Sequence[str] = EXCLUDED_IDS) -> DataFrame:
    kept = exclude_ids(isotopes, "seal_id", excluded)
    kept = require(kept, ["d13c", "length_recovery", "recovery_days"])
    dated = apply_overrides(date_segments(kept), overrides)
    return trailing_day_mean(dated, "seal_id", "segment_date", {"d13c": "mean7_d13c", "d15n": "mean7_d15n"})


def analysis_table(
    isotopes: DataFrame,
    track: DataFrame,
    dive_type: DataFrame,
    dive_stat: DataFrame,
    repr_state: DataFrame,
    overrides: DataFrame,
    excluded: Sequence[str] = EXCLUDED_IDS,
    unwrap_first: bool = False,
) -> DataFrame:
    """Segments with date, weekly means, position, drift and reproductive state."""
    segments = prepare_segments(isotopes, overrides, excluded)
    placed = day_join(segments, daily_track(track, unwrap_first), "seal_id", "segment_date")
    placed = placed.withColumn("days_since_deployment", F.col("segment_days") - F.col("deployment_days"))
    placed = placed.withColumn("lon360", unwrap_longitude(F.col("lon")))
    drift = daily_drift(dive_type, dive_stat).select("seal_id", "segment_date", "five_day_drift")
    drifted = day_join(placed, drift, "seal_id", "segment_date")
    return natural_join(drifted, repr_state)


def model_rows(analysis: DataFrame) -> DataFrame:
    """Rows complete in every predictor, so that all models see the same data."""
    return require(analysis, ["five_day_drift", "lon360", "repr_state"])
