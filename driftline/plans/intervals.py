"""From fitted coefficients to prediction grids and interval summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.scalars import axis_by, axis_length_out
from driftline.operators.aggregates import LOWER_P, UPPER_P, draw_summary, outer_quantiles
from driftline.operators.grids import distinct_axis, expand_grid
from driftline.operators.quantiles import group_quantiles
from driftline.session import settle

# The latitude axis and the step of the drift axis.
LAT_LOW = 35.0
LAT_HIGH = 60.0
AXIS_POINTS = 25
DRIFT_STEP = 10.0


def trimmed_range(df: DataFrame, column: str) -> tuple[float, float]:
    row = outer_quantiles(df, column).first()
    return row[f"{column}_lwr"], row[f"{column}_upr"]


def prediction_grid(
    model_rows: DataFrame,
    animal: str = "seal_id",
    lon: str = "lon360",
    drift: str = "five_day_drift",
    state: str = "repr_state",
    lat: str = "lat",
    full_drift_axis: bool = False,
) -> DataFrame:
    """All combinations of latitude, trimmed longitude, drift, state and animal.

    The rows are settled once; both ranges come from one pass over them.  States are
    gathered where the grid is made, not on the driver.
    """
    rows = settle(model_rows.select(animal, lon, drift, state))
    ends = group_quantiles(rows, [], {
        f"{side}{i}": (column, p) for i, column in enumerate((lon, drift)) for side, p in (("low", LOWER_P), ("high", UPPER_P))}).first()
    lon_low, lon_high, drift_low, drift_high = (ends[c] for c in ("low0", "high0", "low1", "high1"))
    drift_axis = (
        axis_length_out(drift_low, drift_high, AXIS_POINTS)
        if full_drift_axis
        else axis_by(drift_low, drift_high, DRIFT_STEP)
    )
    axes: dict[str, Sequence] = {
        lat: axis_length_out(LAT_LOW, LAT_HIGH, AXIS_POINTS),
        lon: axis_length_out(lon_low, lon_high, AXIS_POINTS),
        drift: drift_axis,
    }
    states = rows.select(state).distinct().agg(F.array_sort(F.collect_list(state))).scalar()
    return expand_grid(distinct_axis(rows, animal), axes).withColumn(state, F.explode(states))


def interval_by(draws: DataFrame, keys: Sequence[str], value: str, back_transform: bool = False) -> DataFrame:
    """Mean and 95 % limits per key; ``back_transform`` undoes a log response."""
    summary = draw_summary(draws, keys, value)
    if back_transform:
        for c in (value, f"{value}_lwr", f"{value}_upr"):
            summary = summary.withColumn(c, F.exp(c))
    return summary
