import datetime as dt
import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from driftline.functions import bins, growth, scalars, timeconv

# Worked examples: id, linf, lrec, recovery day, offset, days from recovery back to the start.
WORKED = [
    ("X822", 9.83, 8.6, 16816, 0.1, -132.6829),
    ("5430", 9.83, 9.8, 16823, 0.1, -369.7508),
    ("X 58", 12.45, 12.6, 16825, 0.1, -388.6307),
    ("5055", 10.49, 10.4, 16832, 0.1, -322.4887),
    ("B 66", 11.63, 11.7, 18665, 1e-6, -1219.5985),
    ("9838", 14.41, 15.0, 18664, 1e-6, -1556.3728),
    ("6564", 14.41, 14.5, 17927, 1e-6, -1505.4637),
    ("PM695", 16.29, 17.6, 17951, 1e-6, -1820.4999),
    ("7019", 14.41, 14.0, 17927, 0.1, -323.1181),
    ("3190", 9.83, 8.2, 16458, 0.1, -114.7083),
]
# Calendar day of the start with the default offset.
START_DAYS = {
    "X822": 16683, "5430": 16453, "5055": 16509, "B 66": 18307, "9838": 18191, "6564": 17472,
    "PM695": 17386, "7019": 17603, "3190": 16343,
}


def values(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize("row", WORKED, ids=lambda r: r[0])
def test_growth_start_examples(spark, row):
    name, linf, lrec, rec, offset, days = row
    args = F.lit(linf), F.lit(lrec), F.lit(float(rec))
    got, default = values(
        spark, growth.growth_start(*args, offset), F.floor(growth.growth_start(*args))
    )
    assert got - rec == pytest.approx(days, abs=5e-4)
    if name in START_DAYS:
        assert default == START_DAYS[name]


def test_known_length_override(spark):
    start = growth.start_from_known_length(F.lit(14.5), F.lit(7.86), F.lit(17653.0))
    rate = growth.growth_rate(F.lit(14.5))
    back = growth.segment_day(F.lit(7.86), F.lit(14.5), rate, start)
    s, k, b = values(spark, start, rate, back)
    assert s == pytest.approx(17581.693356, abs=1e-6)
    assert k == pytest.approx(0.0109532106, abs=1e-10)
    assert b == pytest.approx(17653, abs=1e-9)


def test_realised_rate_equals_predicted_rate_for_solved_starts(spark):
    df = spark.createDataFrame([(9.83, 8.6, 16816.0), (12.45, 12.6, 16825.0)], "linf double, l double, rec double")
    linf, length, rec = F.col("linf"), F.col("l"), F.col("rec")
    start = growth.growth_start(linf, length, rec)
    realised = growth.realised_rate(linf, length, rec, start)
    predicted = growth.growth_rate(growth.effective_asymptote(linf, length))
    for a, b in df.select(realised, predicted).collect():
        assert a == pytest.approx(b, rel=1e-10)


def test_segment_day_inverts_length(spark):
    length = growth.length_at(F.lit(250.0), F.lit(12.0), F.lit(0.0132), F.lit(30.0))
    (day,) = values(spark, growth.segment_day(length, F.lit(12.0), F.lit(0.0132), F.lit(30.0)))
    assert day == pytest.approx(250.0, abs=1e-9)


def test_logarithms_of_nothing_are_null(spark):
    got = values(
        spark,
        growth.segment_day(F.lit(12.0), F.lit(12.0), F.lit(0.01), F.lit(0.0)),
        growth.rate_from_length(F.lit(12.0), F.lit(12.0), F.lit(100.0)),
        growth.rate_from_length(F.lit(5.0), F.lit(12.0), F.lit(0.0)),
        growth.safe_ln(F.lit(0.0)),
    )
    assert list(got) == [None] * 4


def test_serial_days(spark):
    day, minute, back, days = values(
        spark,
        timeconv.serial_to_date(F.lit(735861.99)),
        timeconv.serial_to_minute(F.lit(735861.5 + 61 / 86400)).cast("string"),
        timeconv.calendar_to_serial(F.lit(2014), F.lit(9), F.lit(19)),
        timeconv.day_to_date(F.lit(-0.5)),
    )
    assert day == dt.date(2014, 9, 19)
    assert minute == "2014-09-19 12:01:00"
    assert back == 735861
    assert days == dt.date(1969, 12, 31)


def test_text_dates(spark):
    got = values(
        spark,
        timeconv.parse_us_date(F.lit("1/16/2016")),
        timeconv.parse_dashed_date(F.lit("5-Sep-2015 10:11:12")),
        timeconv.parse_dashed_date(F.lit("18-ene-2015")),
        timeconv.parse_us_date(F.lit("nothing")),
        timeconv.parse_us_minute(F.lit(" 1/2/2016 3:04 ")).cast("string"),
    )
    assert list(got) == [dt.date(2016, 1, 16), dt.date(2015, 9, 5), None, None, "2016-01-02 03:04:00"]


def test_days_since_june(spark):
    got = values(
        spark,
        *[timeconv.days_since_june(F.lit(d).cast("date")) for d in ("2015-06-01", "2015-05-31", "2016-01-01")],
    )
    assert list(got) == [0, 364, 214]


@pytest.mark.parametrize(
    "x, carbon, nitrogen",
    [
        (-19.0, "Low", "High"), (-18.5, "Low", "High"), (-18.0, "Low-medium", "High"), (-17.5, "Medium", "High"),
        (-17.0, "Medium-high", "High"), (-16.9, "High", "High"), (-19.1, "High", "High"), (11.0, "High", "Low"),
        (12.5, "High", "Medium"), (14.0, "High", "Medium-high"), (15.5, "High", "High"), (10.9, "High", "High"),
    ],
)
def test_class_edges(spark, x, carbon, nitrogen):
    assert list(values(spark, bins.carbon_class(F.lit(x)), bins.nitrogen_class(F.lit(x)))) == [carbon, nitrogen]


def test_class_extras(spark):
    got = values(
        spark,
        bins.carbon_class(F.lit(-19.1), below_apart=True),
        bins.carbon_class(F.lit(None).cast("double")),
        bins.relabel(F.lit("Medium"), bins.CARBON_NAMES, bins.CARBON_LABELS),
        bins.class_order(F.lit("Medium-high"), bins.NITROGEN_NAMES),
    )
    assert list(got) == ["Below", None, "-17.9 to -17.5", 3]


def test_longitude_and_ids(spark):
    got = values(
        spark,
        scalars.unwrap_longitude(F.lit(179.0)),
        scalars.unwrap_longitude(F.lit(-179.0)),
        scalars.unwrap_longitude(F.lit(0.0)),
        scalars.normalize_id(F.lit(" X  1 ")),
        scalars.nan_to_null(F.lit(float("nan"))),
    )
    assert list(got) == [-181.0, -179.0, 0.0, "X 1", None]


def test_normal_quantile(spark):
    probabilities = [1e-300, 1e-20, 1e-6, 0.01, 0.0749, 0.0751, 0.5, 0.8, 0.999999]
    rows = spark.createDataFrame([(p,) for p in probabilities], "p double").select("p", scalars.normal_quantile(F.col("p")))
    for p, z in rows.collect():
        assert z == pytest.approx(NormalDist().inv_cdf(p), abs=1e-12)
    assert list(values(spark, scalars.normal_quantile(F.lit(0.0)), scalars.normal_quantile(F.lit(1.0)))) == [None, None]


def test_axes():
    assert scalars.axis_by(0.1, 0.4, 10.0) == [0.1]
    assert scalars.axis_by(0.0, 30.0, 10.0) == [0.0, 10.0, 20.0, 30.0]
    assert scalars.axis_length_out(35.0, 60.0, 25)[-1] == 60.0
    assert len(scalars.repeated_axis(-3, 4, 23)) == 184


def test_keyed_weights(spark):
    u = scalars.keyed_uniform(F.col("id"), F.lit(69))
    rows = spark.range(20000).select(u.alias("u"), scalars.poisson_one(u).alias("w"))
    mean_u, mean_w, var_w = rows.agg(F.avg("u"), F.avg("w"), F.var_samp("w")).first()
    assert mean_u == pytest.approx(0.5, abs=0.01)
    assert mean_w == pytest.approx(1.0, abs=0.03)
    assert var_w == pytest.approx(1.0, abs=0.05)


def test_band(spark):
    mean, low, high = values(spark, *scalars.band(F.lit(1.0), F.lit(0.5)))
    assert (mean, low, high) == pytest.approx((math.e, math.exp(0.5), math.exp(1.5)))
