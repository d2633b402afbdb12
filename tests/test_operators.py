import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators.aggregates import (
    daily_position,
    bounding_box,
    box_stats,
    fixed_histogram,
    histogram,
    mass_change,
    one_way_anova,
    pretty_breaks,
    trip_scalars,
)
from driftline.operators.filters import exclude_ids, nan_as_null, standardise, within_sigma
from driftline.operators.grids import draws_to_long, dummies, expand_grid, levels
from driftline.operators.joins import assert_unique, box_extract, day_join, lookup, natural_join, nearest_in_time
from driftline.operators.quantiles import group_quantiles
from driftline.operators.skew import number_rows, with_neighbours
from driftline.operators.windows import (
    centred_row_mean,
    day_index,
    first_per_day,
    ordered_series,
    stride_sample,
    trailing_day_mean,
)

DAY = dt.date(2020, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def test_trailing_mean_counts_calendar_days(spark):
    rows = [("a", day(0), 1.0), ("a", day(0), 3.0), ("a", day(6), 8.0), ("a", day(7), None), ("b", day(3), 5.0), ("a", None, 9.0)]
    df = spark.createDataFrame(rows, "k string, d date, x double")
    got = {(r.k, r.d, r.x): r.m for r in trailing_day_mean(df, "k", "d", {"x": "m"}).collect()}
    assert got[("a", day(0), 1.0)] == got[("a", day(0), 3.0)] == 2.0
    assert got[("a", day(6), 8.0)] == 4.0
    assert got[("a", day(7), None)] == 8.0
    assert got[("b", day(3), 5.0)] == 5.0
    assert got[("a", None, 9.0)] is None


def test_centred_mean_needs_full_frames(spark):
    rows = [("a", day(i * 2), float(i)) for i in range(7)] + [("b", day(0), 4.0)]
    rows[6] = ("a", day(12), None)
    df = spark.createDataFrame(rows, "k string, d date, x double")
    got = {(r.k, r.d): r.m for r in centred_row_mean(df, "k", "d", "x", "m").collect()}
    assert [got[("a", day(i * 2))] for i in range(7)] == [None, None, 2.0, 3.0, None, None, None]
    assert got[("b", day(0))] is None


def test_day_index_and_first_of_day(spark):
    rows = [("a", day(0), 2, 1.0), ("a", day(0), 1, 2.0), ("a", day(9), 3, 3.0)]
    df = spark.createDataFrame(rows, "k string, d date, t int, x double")
    assert {(r.d, r.day_index) for r in day_index(df, "k", "d").collect()} == {(day(0), 1), (day(9), 2)}
    first = first_per_day(df, "k", "d", [F.col("t")], ["t", "x"])
    assert {(r.d, r.t, r.x) for r in first.collect()} == {(day(0), 1, 2.0), (day(9), 3, 3.0)}
    assert [r.d for r in ordered_series(df, "k", "d", ["t"]).collect()] == [day(0), day(0), day(9)]


def test_stride(spark):
    df = spark.range(100).select(F.lit("a").alias("k"), "id").unionByName(spark.range(10).select(F.lit("b").alias("k"), "id"))
    got = stride_sample(df, "k", [F.col("id")]).groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m")).collect()
    assert {(r.k, r.n, r.m) for r in got} == {("a", 34, 99), ("b", 10, 9)}  # round(2.5) is 3


@pytest.fixture
def skewed(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 == 0 else f"k{i % 7}", i, round(rng.uniform(0, 20), 1)) for i in range(200)]
    rows += [(None, 1000 + i, None if i == 2 else 5.0) for i in range(6)]
    rows += [("one", 2000, 7.0), ("hot", 3000, None)]
    return spark.createDataFrame(rows, "k string, id int, x double")


def by_group(df):
    groups = {}
    for r in sorted(df.collect(), key=lambda r: r.id):
        groups.setdefault(r.k, []).append(r)
    return groups


def check_numbers(df):
    groups = by_group(df)
    got = {r.id: (r.row_no, r.group_rows) for r in number_rows(df, ["k"], [F.col("id")]).collect()}
    assert len(got) == df.count()
    for rows in groups.values():
        for i, r in enumerate(rows, start=1):
            assert got[r.id] == (i, len(rows))


def check_neighbours(df, block_rows):
    shifted = with_neighbours(df, ["k"], [F.col("id")], "x", [-2, -1, 1], block_rows=block_rows)
    got = {r.id: (r["at-2"], r["at-1"], r["at+1"]) for r in shifted.collect()}
    assert len(got) == df.count()
    for rows in by_group(df).values():
        x = [r.x for r in rows]
        for i, r in enumerate(rows):
            expected = tuple(x[j] if 0 <= j < len(x) else None for j in (i - 2, i - 1, i + 1))
            assert got[r.id] == expected


def check_quantiles(df):
    wanted = {"lo": ("x", 0.025), "mid": ("x", 0.5), "hi": ("x", 0.9), "ids": ("id", 0.3)}
    found = group_quantiles(df, ["k"], wanted, {"n": ("x", "count")}).collect()
    groups = by_group(df)
    assert len(found) == len(groups)
    for r in found:
        x = [v.x for v in groups[r.k] if v.x is not None]
        assert r.n == len(x)
        assert (r.lo, r.mid, r.hi) == pytest.approx(tuple(np.quantile(x, [0.025, 0.5, 0.9])))
        assert r.ids == pytest.approx(np.quantile([v.id for v in groups[r.k]], 0.3))


@pytest.mark.parametrize("block_rows", [1, 3, 1000])
def test_group_work(skewed, block_rows):
    check_numbers(skewed)
    check_neighbours(skewed, block_rows)
    check_quantiles(skewed)


def test_missing_group_keeps_its_row(spark):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "k string, x double")
    rows = group_quantiles(df, ["k"], {"q": ("x", 0.5)}, {"n": ("x", "count"), "m": ("x", "mean")}).collect()
    assert {(r.k, r.n, r.m, r.q) for r in rows} == {("a", 0, None, None), ("b", 1, 2.0, 2.0)}
    assert tuple(group_quantiles(df.limit(0), [], {"q": ("x", 0.5)}, {"n": ("x", "count")}).first()) == (0, None)


def test_whole_table_quantiles(spark, skewed):
    row = group_quantiles(skewed, [], {"a": ("x", 0.1), "b": ("id", 0.77)}, {"m": ("x", "mean"), "low": ("x", "min")}).first()
    x = [r.x for r in skewed.collect() if r.x is not None]
    ids = [r.id for r in skewed.collect()]
    assert (row.a, row.b, row.m) == pytest.approx((np.quantile(x, 0.1), np.quantile(ids, 0.77), np.mean(x)))


def test_type_seven_quantile(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 4.0, 8.0)], "x double")
    assert group_quantiles(df, [], {"q": ("x", 0.025)}).first().q == pytest.approx(1.075)
    assert group_quantiles(df, [], {"q": ("x", 0.5)}, approximate=True).first().q in (2.0, 4.0)


def brute_nearest(samples, fixes):
    found = {}
    for s in samples:
        mine = [f for f in fixes if f[0] == s[0]]
        best = min(mine, key=lambda f: (abs(f[2] - s[2]), f[2], f[1]), default=None)
        found[s[1]] = best[1:] if best else (None, None, None)
    return found


def check_nearest(spark):
    rng = random.Random(3)
    samples = [("hot" if i % 3 else f"k{i % 5}", i, rng.randrange(60)) for i in range(80)] + [("lonely", 900, 5)]
    fixes = [("hot" if i % 2 else f"k{i % 5}", i, rng.randrange(60), float(i)) for i in range(60)]
    left = spark.createDataFrame(samples, "k string, sid int, st int")
    right = spark.createDataFrame(fixes, "k string, fid int, ft int, x double")
    got = nearest_in_time(left, right, "k", "sid", "st", "ft", "fid", ["x"]).collect()
    expected = brute_nearest(samples, fixes)
    assert len(got) == len(samples)
    for r in got:
        assert (r.fid, r.ft, r.x) == expected[r.sid]


def test_nearest(spark):
    check_nearest(spark)


def test_nearest_is_linear(spark):
    times = spark.range(100_000).select(F.lit("one").alias("k"), F.col("id").alias("sid"), (F.col("id") * 10).alias("st"))
    fixes = times.select("k", F.col("sid").alias("fid"), (F.col("st") + 3).alias("ft"))
    found = nearest_in_time(times, fixes, "k", "sid", "st", "ft", "fid", [])
    plan = found._jdf.queryExecution().toString()
    assert "unboundedfollowing" not in plan.lower()
    assert found.where("sid = fid AND gap = 3").count() == 100_000


def test_nearest_tie_takes_earlier_fix(spark):
    left = spark.createDataFrame([("a", 1, 10)], "k string, sid int, st int")
    right = spark.createDataFrame([("a", 5, 12, 2.0), ("a", 7, 8, 1.0), ("a", 6, 8, 3.0)], "k string, fid int, ft int, x double")
    row = nearest_in_time(left, right, "k", "sid", "st", "ft", "fid", ["x"]).first()
    assert (row.fid, row.ft, row.x, row.gap) == (6, 8, 3.0, 2)


def test_box_extract_against_brute_force(spark):
    rng = random.Random(11)
    around = lambda: round(rng.choice([179.9, -180.0]) + rng.randrange(0, 10) / 100, 2)
    points = [(i, day(i % 2), round(10 + rng.randrange(30) / 100, 2), around()) for i in range(60)]
    cells = {(p, day(rng.randrange(2)), round(10 + rng.randrange(30) / 100, 2), around()) for p in ("a", "b") for _ in range(300)}
    grid = [(*c, float(rng.randrange(100))) for c in sorted(cells)]
    found = box_extract(
        spark.createDataFrame(points, "id int, time date, lat double, lon double"),
        spark.createDataFrame(grid, "product string, time date, lat double, lon double, value double"),
        "id",
    )
    got = {(r.id, r.product): (r.mean, r.stdev, r.med, r.cells) for r in found.collect() if r.product}
    expected = {}
    for i, d, lat, lon in points:
        for copy in [lon] + ([lon + 360] if lon - 0.05 < -180 else []) + ([lon - 360] if lon + 0.05 > 180 else []):
            for product, t, clat, clon, v in grid:
                if t == d and lat - 0.05 <= clat <= lat + 0.05 and copy - 0.05 <= clon <= copy + 0.05:
                    expected.setdefault((i, product), []).append(v)
    assert got.keys() == expected.keys()
    for key, v in expected.items():
        sd = np.std(v, ddof=1) if len(v) > 1 else None
        assert got[key][0] == pytest.approx(np.mean(v))
        assert got[key][1] == (pytest.approx(sd) if sd is not None else None)
        assert got[key][2:] == (pytest.approx(np.median(v)), len(v))


def test_joins_on_missing_and_repeated_keys(spark):
    left = spark.createDataFrame([("a", day(0)), ("a", None), ("b", day(0))], "k string, d date")
    right = spark.createDataFrame([("a", day(0), 1), ("a", None, 2)], "k string, d date, v int")
    got = {(r.k, r.d): r.v for r in day_join(left, right, "k", "d").collect()}
    assert got == {("a", day(0)): 1, ("a", None): None, ("b", day(0)): None}
    assert natural_join(left, right.drop("d")).count() == 4
    with pytest.raises(ValueError):
        assert_unique(right, ["k"])
    assert lookup(left, right.limit(1).drop("d"), "k").count() == 3


def test_sigma_filter_includes_limits_and_skips_missing(spark):
    values = [0.0] * 20 + [100.0, None, float("nan")]
    df = nan_as_null(spark.createDataFrame([(v,) for v in values], "x double"))
    assert within_sigma(df, "x").count() == 20
    flat = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert within_sigma(flat, "x").count() == 2
    assert [r.z for r in standardise(flat, {"x": "z"}).collect()] == [None, None]


def test_excluded_ids_drop_missing_ids(spark):
    df = spark.createDataFrame([("X 58",), ("X 58 ",), (None,), ("a",)], "k string")
    assert {r.k for r in exclude_ids(df, "k", ["X 58"]).collect()} == {"X 58 ", "a"}


def test_trip_scalars_take_earliest_peak(spark):
    rows = [("a", day(0), 1.0), ("a", day(3), 5.0), ("a", day(2), 5.0), ("a", day(1), None)]
    row = trip_scalars(spark.createDataFrame(rows, "k string, d date, x double"), "k", "d", "x").first()
    assert (row.drift_sum, row.drift_max_day) == (11.0, day(2))
    assert row.drift_mean == pytest.approx(11 / 3)


def test_mass_change_and_box(spark):
    df = spark.createDataFrame([(334, 495, 1.0, 2.0)], "a int, b int, lat double, lon double")
    assert mass_change(df, "a", "b").first().mass_change == 161
    assert tuple(bounding_box(df, [], "lat", "lon").first()) == (1.0, 1.0, 2.0, 2.0)


def test_histogram_breaks(spark):
    assert pretty_breaks(0.3, 9.7, 5) == (0, 2.0, 5)
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.5, 2.0, 4.0, None)], "x double")
    counts = {r.class_no: r.n for r in fixed_histogram(df, "x", 0.0, 1.0, 4).collect()}
    assert counts == {0: 0, 1: 2, 2: 2, 3: 0, 4: 1, 5: 0}
    outside = {r.class_no: r.n for r in fixed_histogram(df, "x", 1.0, 0.5, 2).collect()}
    assert outside == {0: 1, 1: 2, 2: 1, 3: 1}
    assert sum(r.n for r in histogram(df, "x").collect()) == 5
    assert histogram(df.where("x > 99"), "x").count() == 0


@pytest.mark.parametrize(("low", "step", "n", "classes"), [(3, 10, 11, 10), (3, 10, 10, None), (-7, 100, 40, 13), (1, 1000, 900, None)])
def test_histogram_keeps_every_row_in_its_right_closed_class(spark, low, step, n, classes):
    values = [(low + i) / step for i in range(n)]
    rows = histogram(spark.createDataFrame([(v,) for v in values], "x double"), "x", classes).collect()
    assert sum(r.n for r in rows) == n
    first, unit, count = pretty_breaks(values[0], values[-1], classes or int(np.ceil(np.log2(n) + 1)))
    scaled = round(unit * step)  # the class width in whole steps
    for r in rows:
        under, upper = (first + r.class_no - 1) * scaled, (first + r.class_no) * scaled
        assert r.n == sum(under < low + i <= upper or r.class_no == 1 and low + i == under for i in range(n))


def test_box_stats(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    row = box_stats(spark.createDataFrame([("g", v) for v in values], "g string, x double"), "g", "x").first()
    assert (row.q1, row.median, row.q3, row.whisker_low, row.whisker_high, row.outliers) == (2, 3, 4, 1, 4, 1)


def test_anova(spark):
    groups = {"a": [1.0, 2.0, 3.0], "b": [2.0, 4.0, 9.0], "c": [1e6, 1e6 + 1, 1e6 + 2]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, x double")
    row = one_way_anova(df, "g", ["x"]).first()
    flat = np.concatenate(list(groups.values()))
    between = sum(len(v) * (np.mean(v) - flat.mean()) ** 2 for v in groups.values())
    within = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in groups.values())
    assert row.f_value == pytest.approx((between / 2) / (within / 6), rel=1e-9)
    assert (row.df_between, row.df_within) == (2, 6)


def test_grid_and_reshape(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", None)], "k string, s string")
    assert levels(df, "s") == ["x", "y"]
    coded, names = dummies(df, "s", ["x", "y"])
    assert names == ["s_y"] and {r["s_y"] for r in coded.collect()} == {0.0, 1.0, None}
    with pytest.raises(ValueError):
        levels(df, "s", limit=1)
    grid = expand_grid(df.select("k").distinct(), {"lat": [1.0, 2.0], "state": ["p", "n"]})
    assert grid.count() == 8
    wide = spark.createDataFrame([(1, 2.0, 3.0)], "id int, d1 double, d2 double")
    assert {(r.draw, r.v) for r in draws_to_long(wide, ["id"], ["d1", "d2"], "v").collect()} == {("d1", 2.0), ("d2", 3.0)}


def test_daily_position_holds_no_group_in_one_buffer(spark):
    df = spark.range(1001).selectExpr("'a' AS k", "DATE'2020-01-01' AS d", "IF(id < 1000, id, NULL) AS x", "-id AS y")
    made = daily_position(df, "k", "d", {"x": "mx", "y": "my"})
    assert "percentile" not in made._jdf.queryExecution().toString().lower()
    assert [(r.mx, r.my) for r in made.collect()] == [(499.5, -500.0)]


def test_values_are_counted_in_short_splits_and_ranked_once(spark, monkeypatch):
    from driftline import session
    from driftline.operators import quantiles

    seen = []

    def watched(*args):
        seen.append(spark.conf.get(session.SPLIT))
        return range_slices(*args)

    range_slices = quantiles.range_slices
    monkeypatch.setattr(quantiles, "range_slices", watched)
    before = spark.conf.get(session.SPLIT)
    df = spark.createDataFrame([("a", float(i)) for i in range(41)] + [("b", None)], "k string, x double")
    found = group_quantiles(df, ["k"], {"lo": ("x", 0.025), "mid": ("x", 0.5), "hi": ("x", 0.975)}, {"n": ("x", "count")})
    assert seen == [f"{session.SHORT_SPLIT}b"] and spark.conf.get(session.SPLIT) == before
    # One window row for a value, however many quantiles are asked for.
    windows = [w for w in found._jdf.queryExecution().analyzed().toString().split("\n") if "_copies" in w and "windowspec" in w]
    assert windows and not any("_ask" in w for w in windows)
    assert {tuple(r) for r in found.collect()} == {("a", 41, 1.0, 20.0, 39.0), ("b", 0, None, None, None)}
    with pytest.raises(ZeroDivisionError), session.short_scans(spark):
        1 / 0
    assert spark.conf.get(session.SPLIT) == before
