"""The end-to-end table on a handful of hand-checked rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftline.functions.timeconv import date_to_serial
from driftline.plans.analysis import analysis_table, daily_drift, daily_track, date_segments, model_rows
from driftline.plans.intervals import interval_by, prediction_grid
from driftline.plans.study import overrides_table
from driftline.plans.telemetry import drift_dives, environment_at_tags
from driftline.queries import QUERIES
from driftline.session import slice_count

SEGMENTS = (
    "seal_id string, segment int, d13c double, d15n double, length_recovery double, recovery_days double, "
    "deployment_days double, whisker_column int, whisker_row int, nubbin boolean, distance_from_tip double"
)
START = 17600.0


def serial(days):
    return days + 719529.0


@pytest.fixture
def inputs(spark):
    isotopes = spark.createDataFrame(
        [
            ("A", 1, -18.0, 13.0, 8.6, START + 200, START, 3, 2, True, 4.3),
            ("A", 2, -17.0, 14.0, 8.6, START + 200, START, 3, 2, True, 4.4),
            ("A", 3, None, 14.0, 8.6, START + 200, START, 3, 2, True, 5.0),
            ("6564", 1, -18.5, 12.0, 14.5, 17927.0, START, 3, 3, True, 7.86),
            ("X822", 1, -18.5, 12.0, 14.5, 17927.0, START, 3, 3, True, 7.86),
            ("NoState", 1, -18.5, 12.0, 8.6, START + 200, START, 3, 3, True, 2.0),
            ("C", 1, -18.5, 12.0, 8.6, START + 200, START, 3, 2, None, 2.0),
        ],
        SEGMENTS,
    )
    day = {r.segment: r.segment_days for r in date_segments(isotopes.where("seal_id = 'A'")).collect()}[1]
    track = spark.createDataFrame(
        [("A", serial(int(day)) + h, lat, lon) for h, lat, lon in ((0.1, 40.0, 170.0), (0.5, 50.0, 174.0), (0.9, 42.0, 172.0))]
        + [("6564", serial(17653.2), 45.0, -150.0)],
        "seal_id string, jul_date double, lat double, lon double",
    )
    dive_type = spark.createDataFrame(
        [("A", i, float(i), 2) for i in range(5)] + [("A", 9, 100.0, 1)], "seal_id string, dive_number int, drift_rate double, dive_type int"
    )
    dive_stat = spark.createDataFrame(
        [("A", i, serial(int(day)) - 2 + i + 0.3) for i in range(5)], "seal_id string, dive_number int, jul_date double"
    )
    states = spark.createDataFrame([("A", "Pregnant"), ("6564", None), ("C", "Non-pregnant")], "seal_id string, repr_state string")
    return isotopes, track, dive_type, dive_stat, states


def test_analysis_table(spark, inputs):
    table = analysis_table(*inputs, overrides_table(spark))
    rows = {(r.seal_id, r.segment): r for r in table.collect()}
    assert set(rows) == {("A", 1), ("A", 2), ("6564", 1), ("C", 1)}
    first = rows[("A", 1)]
    assert (first.lat, first.lon, first.lon360) == (42.0, 172.0, -188.0)
    assert first.five_day_drift == 2.0
    assert first.deployment_duration == 200.0
    assert rows[("A", 2)].mean7_d13c == -17.5 and rows[("A", 2)].mean7_d15n == 13.5
    over = rows[("6564", 1)]
    assert over.segment_date == dt.date(2018, 5, 2) and over.lat == 45.0
    assert over.days_since_deployment == pytest.approx(17653 - 17581.693356, abs=1e-5)
    assert rows[("C", 1)].segment_days is None and rows[("C", 1)].deployment_days is None
    assert [r.seal_id for r in model_rows(table).collect()] == ["A"]


def test_positions_across_the_date_line(spark):
    track = spark.createDataFrame([("A", 736000.1, 1.0, 179.0), ("A", 736000.2, 1.0, -179.0)], "seal_id string, jul_date double, lat double, lon double")
    assert daily_track(track).first().lon == 0.0
    assert daily_track(track, unwrap_first=True).first().lon == -180.0


def test_drift_without_time_is_kept_apart(spark):
    dive_type = spark.createDataFrame([("A", 1, 1.0, 2), ("A", 2, 3.0, 2)], "seal_id string, dive_number int, drift_rate double, dive_type int")
    dive_stat = spark.createDataFrame([("A", 1, 736000.0)], "seal_id string, dive_number int, jul_date double")
    assert daily_drift(dive_type, dive_stat).where(F.col("segment_date").isNull()).count() == 1


def test_prediction_grid_axes(spark):
    rows = spark.createDataFrame(
        [("A", 40.0, -150.0 - i, 0.01 * i, "Pregnant") for i in range(10)] + [("B", 41.0, -151.0, 0.02, "Non-pregnant")],
        "seal_id string, lat double, lon360 double, five_day_drift double, repr_state string",
    )
    grid = prediction_grid(rows)
    assert grid.count() == 25 * 25 * 1 * 2 * 2
    assert prediction_grid(rows, full_drift_axis=True).select("five_day_drift").distinct().count() == 25
    draws = grid.withColumn("value", F.col("lat") * 0).withColumn("draw", F.lit(1))
    summary = interval_by(draws, ["lat", "seal_id"], "value", back_transform=True)
    assert summary.count() == 50 and {r.value for r in summary.collect()} == {1.0}


def test_tag_environment(spark):
    tags = spark.createDataFrame(
        [("t1", 40.0, -130.0, 736000.5, 1), ("t1", 41.0, -130.0, 736000.2, 2), ("t1", 41.0, -130.0, 736001.2, 3)],
        "ptt string, lat double, lon double, serial double, fpt int",
    )
    day = spark.range(1).select(F.date_from_unix_date(F.lit(736000 - 719529))).first()[0]
    assert spark.range(1).select(date_to_serial(F.lit(day))).first()[0] == 736000
    grid = spark.createDataFrame([("sst", day, 41.02, -130.01, 5.0), ("sst", day, 40.98, -130.0, 7.0)], "product string, time date, lat double, lon double, value double")
    rows = {r.time: r for r in environment_at_tags(tags, grid, ["sst", "wind"]).collect()}
    assert len(rows) == 2
    assert (rows[day].fpt, rows[day].sst_mean, rows[day].sst_med, rows[day].wind_mean) == (2, 6.0, 6.0, None)


def test_exported_dive_columns(spark):
    dives = spark.createDataFrame([("a", 1, 0.1, 2, "drift", 7), ("a", 2, 0.1, 1, "other", 7)], "SealID string, DiveNumber int, DriftRate double, DiveType int, DiveTypeName string, extra int")
    rows = drift_dives(dives).collect()
    assert len(rows) == 1 and "extra" not in rows[0].asDict()


def test_growth_curve_is_dealt_over_all_tasks(spark, tmp_path):
    part = spark.createDataFrame([(1, 2), (2, 1), (3, None), (None, 1), (4, 0)], "p_partkey bigint, p_size int")
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    curve = QUERIES["q_growth_curve"](spark, str(tmp_path))
    assert curve.rdd.getNumPartitions() == slice_count(spark)
    assert sorted((r.p_partkey or 0, r.day) for r in curve.collect()) == [
        (0, 1.0), *[(1, i / 10) for i in range(10, 21)], (2, 1.0)]
