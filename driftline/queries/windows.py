"""Daily resampling, moving averages, numbering and sampling along tracks."""

from pyspark.sql import functions as F

from driftline.operators.aggregates import daily_mean, daily_position
from driftline.operators.windows import (
    centred_day_mean,
    centred_row_mean,
    day_index,
    first_per_day,
    ordered_series,
    stride_sample,
    trailing_day_mean,
)
from driftline.queries.registry import FIXES, query, rnd, rounded, sql_rnd

def time_order():
    return [F.col("ts").asc(), F.col("fix_id").asc()]


@query(
    "q_daily_median",
    f"""WITH {FIXES}
SELECT animal, day, {sql_rnd('quantile_cont(lat, 0.5)')} AS lat_median, {sql_rnd('quantile_cont(lon, 0.5)')} AS lon_median
FROM fixes GROUP BY animal, day""",
)
def q_daily_median(t):
    medians = daily_position(t.fixes(), "animal", "day", {"lat": "lat_median", "lon": "lon_median"})
    return rounded(medians, lat_median=6, lon_median=6)


@query(
    "q_trailing7",
    f"""WITH {FIXES}
SELECT fix_id, animal, day, {sql_rnd('''avg(value) OVER (PARTITION BY animal ORDER BY day
  RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)''')} AS mean7
FROM fixes""",
)
def q_trailing7(t):
    means = trailing_day_mean(t.fixes(), "animal", "day", {"value": "mean7"})
    return means.select("fix_id", "animal", "day", rnd("mean7").alias("mean7"))


DAILY = "daily AS (SELECT animal, day, avg(value) AS value FROM fixes GROUP BY animal, day)"


@query(
    "q_centered5",
    f"""WITH {FIXES}, {DAILY}
SELECT animal, day, {sql_rnd('value')} AS value,
  CASE WHEN count(value) OVER w = 5 THEN {sql_rnd('avg(value) OVER w')} END AS mean5
FROM daily WINDOW w AS (PARTITION BY animal ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
)
def q_centered5(t):
    daily = daily_mean(t.fixes(), "animal", "day", "value", "value")
    return rounded(centred_row_mean(daily, "animal", "day", "value", "mean5"), value=6, mean5=6)


@query(
    "q_centered5_days",
    f"""WITH {FIXES}, {DAILY}
SELECT animal, day, {sql_rnd('''avg(value) OVER (PARTITION BY animal ORDER BY day
  RANGE BETWEEN INTERVAL 2 DAYS PRECEDING AND INTERVAL 2 DAYS FOLLOWING)''')} AS mean5
FROM daily""",
)
def q_centered5_days(t):
    daily = daily_mean(t.fixes(), "animal", "day", "value", "value")
    means = centred_day_mean(daily, "animal", "day", "value", "mean5")
    return means.select("animal", "day", rnd("mean5").alias("mean5"))


@query(
    "q_day_index",
    """SELECT animal, day, row_number() OVER (PARTITION BY animal ORDER BY day)::bigint AS day_index
FROM (SELECT DISTINCT user_id AS animal, ts::date AS day FROM events)""",
)
def q_day_index(t):
    return day_index(t.fixes(), "animal", "day")


@query(
    "q_first_per_day",
    f"""WITH {FIXES}
SELECT animal, day, fix_id, value FROM fixes
QUALIFY row_number() OVER (PARTITION BY animal, day ORDER BY ts, fix_id) = 1""",
)
def q_first_per_day(t):
    return first_per_day(t.fixes(), "animal", "day", [F.col("ts"), F.col("fix_id")], ["fix_id", "value"])


@query(
    "q_stride",
    f"""WITH {FIXES}, numbered AS (
  SELECT fix_id, animal, row_number() OVER (PARTITION BY animal ORDER BY ts, fix_id) AS rn,
         greatest(1, round(count(*) OVER (PARTITION BY animal) / 40.0::double))::bigint AS stride
  FROM fixes)
SELECT fix_id, animal, stride FROM numbered WHERE (rn - 1) % stride = 0""",
)
def q_stride(t):
    return stride_sample(t.fixes(), "animal", time_order()).select("fix_id", "animal", "stride")


@query(
    "q_ordered_series",
    f"""WITH {FIXES}, {DAILY}
SELECT animal, day, {sql_rnd('value')} AS value FROM daily ORDER BY animal, day""",
)
def q_ordered_series(t):
    daily = daily_mean(t.fixes(), "animal", "day", "value", "value")
    return rounded(ordered_series(daily, "animal", "day", ["value"]), value=6)
