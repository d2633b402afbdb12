"""Filters, standardising, dates, longitudes, classes and lookups of single rows."""

from pyspark.sql import functions as F

from driftline.functions import bins, timeconv
from driftline.functions.growth import safe_ln
from driftline.functions.scalars import unwrap_longitude
from driftline.operators.filters import (
    add_day_key,
    exclude_ids,
    key_prefix,
    require,
    standardise,
    within_sigma,
)
from driftline.queries.registry import FIXES, query, rnd, sql_rnd


@query(
    "q_outlier3sd",
    """SELECT event_id, value FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)
WHERE abs(value - m) <= 3 * s""",
)
def q_outlier3sd(t):
    return within_sigma(t.events.select("event_id", "value"), "value", 3.0)


@query(
    "q_zscore",
    f"""SELECT l_orderkey, l_linenumber,
  {sql_rnd('(l_extendedprice - pm) / ps')} AS price_z, {sql_rnd('(l_quantity - qm) / qs')} AS quantity_z
FROM lineitem, (SELECT avg(l_extendedprice) AS pm, stddev_samp(l_extendedprice) AS ps,
  avg(l_quantity) AS qm, stddev_samp(l_quantity) AS qs FROM lineitem)""",
)
def q_zscore(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    scored = standardise(rows, {"l_extendedprice": "price_z", "l_quantity": "quantity_z"})
    return scored.select("l_orderkey", "l_linenumber", rnd("price_z").alias("price_z"), rnd("quantity_z").alias("quantity_z"))


@query(
    "q_exclude_complete",
    """WITH gaps AS (SELECT event_id, user_id::varchar AS animal, event_type,
  CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)
SELECT event_id, animal, value FROM gaps
WHERE animal NOT IN ('3', '7', '11') AND event_type = 'purchase' AND value IS NOT NULL""",
)
def q_exclude_complete(t):
    gaps = t.events.select(
        "event_id",
        F.col("user_id").cast("string").alias("animal"),
        "event_type",
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
    )
    kept = exclude_ids(gaps, "animal", ["3", "7", "11"]).where(F.col("event_type") == "purchase")
    return require(kept, ["value"]).select("event_id", "animal", "value")


@query(
    "q_datenum",
    """WITH d AS (SELECT o_orderkey, 719529::double + (o_orderdate::date - date '1970-01-01')
    + (o_orderkey % 1000) / 1000.0::double AS serial FROM orders),
e AS (SELECT o_orderkey, serial, date '1970-01-01' + floor(serial - 719529)::int AS day,
    (floor((serial - 719529) * 86400 / 60) * 60)::bigint AS secs FROM d)
SELECT o_orderkey, day, secs AS minute_seconds,
  (day - date '1970-01-01' + 719529)::bigint AS serial_day,
  (day - make_date((year(day) - CASE WHEN month(day) < 6 THEN 1 ELSE 0 END)::int, 6, 1))::bigint AS since_june
FROM e""",
)
def q_datenum(t):
    days = F.unix_date(F.to_date("o_orderdate"))
    serial = F.lit(719529.0) + days + (F.col("o_orderkey") % 1000) / 1000.0
    dated = t.orders.select("o_orderkey", serial.alias("serial")).withColumn(
        "day", timeconv.serial_to_date(F.col("serial"))
    )
    return dated.select(
        "o_orderkey",
        "day",
        F.unix_seconds(timeconv.serial_to_minute(F.col("serial"))).alias("minute_seconds"),
        timeconv.date_to_serial(F.col("day")).cast("bigint").alias("serial_day"),
        timeconv.days_since_june(F.col("day")).cast("bigint").alias("since_june"),
    )


@query(
    "q_text_dates",
    """WITH d AS (SELECT o_orderkey, o_orderdate::date AS day FROM orders)
SELECT o_orderkey, day AS from_us, day AS from_dashed,
  epoch(day::timestamp)::bigint + (o_orderkey % 24) * 3600 AS minute_seconds FROM d""",
)
def q_text_dates(t):
    day = F.to_date("o_orderdate")
    texts = t.orders.select(
        "o_orderkey",
        F.date_format(day, "M/d/yyyy").alias("us"),
        F.concat(F.date_format(day, "d-MMM-yyyy"), F.lit(" 12:30:00")).alias("dashed"),
        F.concat(F.date_format(day, "M/d/yyyy"), F.lit(" "), (F.col("o_orderkey") % 24).cast("string"), F.lit(":00")).alias("minute"),
    )
    return texts.select(
        "o_orderkey",
        timeconv.parse_us_date(F.col("us")).alias("from_us"),
        timeconv.parse_dashed_date(F.col("dashed")).alias("from_dashed"),
        F.unix_seconds(timeconv.parse_us_minute(F.col("minute"))).alias("minute_seconds"),
    )


@query(
    "q_lon_unwrap",
    f"""WITH {FIXES} SELECT fix_id, {sql_rnd('CASE WHEN lon > 0 THEN lon - 360 ELSE lon END')} AS lon360 FROM fixes""",
)
def q_lon_unwrap(t):
    return t.fixes().select("fix_id", rnd(unwrap_longitude(F.col("lon"))).alias("lon360"))


CARBON_CASE = """CASE WHEN x >= -19 AND x <= -18.5 THEN 'Low' WHEN x > -18.5 AND x <= -18 THEN 'Low-medium'
  WHEN x > -18 AND x <= -17.5 THEN 'Medium' WHEN x > -17.5 AND x <= -17 THEN 'Medium-high' ELSE 'High' END"""


@query(
    "q_bins_closed_right",
    f"""WITH d AS (SELECT l_orderkey, l_linenumber, -20.0::double + l_quantity / 12.5::double AS x FROM lineitem),
e AS (SELECT *, {CARBON_CASE} AS class FROM d)
SELECT l_orderkey, l_linenumber, class,
  CASE class WHEN 'Low' THEN '-19 to -18.5' WHEN 'Low-medium' THEN '-18.4 to -18' WHEN 'Medium' THEN '-17.9 to -17.5'
    WHEN 'Medium-high' THEN '-17.4 to -17' ELSE '-16.9 to -16' END AS label,
  CASE class WHEN 'Low' THEN 1 WHEN 'Low-medium' THEN 2 WHEN 'Medium' THEN 3 WHEN 'Medium-high' THEN 4 ELSE 5 END::int AS class_order,
  CASE WHEN x < -19 THEN 'Below' ELSE class END AS class_apart
FROM e""",
)
def q_bins_closed_right(t):
    x = F.lit(-20.0) + F.col("l_quantity") / 12.5
    classed = t.lineitem.select("l_orderkey", "l_linenumber", x.alias("x")).withColumn(
        "class", bins.carbon_class(F.col("x"))
    )
    return classed.select(
        "l_orderkey",
        "l_linenumber",
        "class",
        bins.relabel(F.col("class"), bins.CARBON_NAMES, bins.CARBON_LABELS).alias("label"),
        bins.class_order(F.col("class"), bins.CARBON_NAMES).alias("class_order"),
        bins.carbon_class(F.col("x"), below_apart=True).alias("class_apart"),
    )


@query(
    "q_bins_closed_left",
    """WITH d AS (SELECT l_orderkey, l_linenumber, 10.0::double + l_quantity / 8.0::double AS x FROM lineitem),
classed AS (SELECT l_orderkey, l_linenumber, CASE WHEN x >= 11 AND x < 12.5 THEN 'Low' WHEN x >= 12.5 AND x < 14 THEN 'Medium'
  WHEN x >= 14 AND x < 15.5 THEN 'Medium-high' ELSE 'High' END AS class FROM d)
SELECT *, CASE class WHEN 'Low' THEN '11 to 12.4' WHEN 'Medium' THEN '12.5 to 13.9' WHEN 'Medium-high' THEN '14 to 15.4'
  ELSE '15.5 to 17.3' END AS label FROM classed""",
)
def q_bins_closed_left(t):
    x = F.lit(10.0) + F.col("l_quantity") / 8.0
    classed = t.lineitem.select("l_orderkey", "l_linenumber", bins.nitrogen_class(x).alias("class"))
    return classed.withColumn("label", bins.relabel(F.col("class"), bins.NITROGEN_NAMES, bins.NITROGEN_LABELS))


@query(
    "q_day_key",
    """SELECT event_id, user_id::varchar || '-' || (ts::date)::varchar AS seal_date,
  substr(user_id::varchar || '-' || (ts::date)::varchar, 1, 3) AS prefix FROM events""",
)
def q_day_key(t):
    animals = t.events.select("event_id", F.col("user_id").cast("string").alias("animal"), F.to_date("ts").alias("day"))
    return add_day_key(animals, "animal", "day").select(
        "event_id", "seal_date", key_prefix(F.col("seal_date")).alias("prefix")
    )


@query(
    "q_log_exp",
    f"""WITH d AS (SELECT event_id, CASE WHEN value > 0 THEN ln(value) END AS log_value FROM events)
SELECT event_id, {sql_rnd('log_value')} AS log_value, {sql_rnd('exp(log_value)')} AS back FROM d""",
)
def q_log_exp(t):
    log = safe_ln(F.col("value"))
    return t.events.select("event_id", rnd(log).alias("log_value"), rnd(F.exp(log)).alias("back"))


@query("q_distinct_animals", "SELECT DISTINCT user_id AS animal FROM events")
def q_distinct_animals(t):
    return t.events.select(F.col("user_id").alias("animal")).distinct()
