"""Keyed joins, nearest-time matching and box extraction."""

from pyspark.sql import functions as F

from driftline.functions.scalars import axis_length_out
from driftline.operators.aggregates import daily_mean
from driftline.operators.grids import expand_grid
from driftline.operators.joins import box_extract, day_join, lookup, natural_join, nearest_in_time, two_key_join
from driftline.queries.registry import FIXES, query, rounded, sql_rnd


@query(
    "q_left_day_join",
    f"""WITH {FIXES}, daily AS (SELECT animal, day, avg(value) AS value FROM fixes GROUP BY animal, day),
samples AS (SELECT o_orderkey, o_custkey AS animal, date '2024-01-01' + (o_orderkey % 35)::int AS day FROM orders)
SELECT o_orderkey, animal, day, {sql_rnd('value')} AS value FROM samples LEFT JOIN daily USING (animal, day)""",
)
def q_left_day_join(t):
    samples = t.orders.select(
        "o_orderkey",
        F.col("o_custkey").alias("animal"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 35).cast("int")).alias("day"),
    )
    daily = daily_mean(t.fixes(), "animal", "day", "value", "value")
    return rounded(day_join(samples, daily, "animal", "day"), value=6)


@query(
    "q_two_key_join",
    """WITH stat AS (SELECT l_orderkey, l_linenumber, min(l_shipdate::date) AS first_day FROM lineitem
  WHERE l_quantity > 25 GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_quantity, first_day FROM lineitem LEFT JOIN stat USING (l_orderkey, l_linenumber)""",
)
def q_two_key_join(t):
    keys = ["l_orderkey", "l_linenumber"]
    stat = (
        t.lineitem.where(F.col("l_quantity") > 25)
        .groupBy(*keys)
        .agg(F.min(F.to_date("l_shipdate")).alias("first_day"))
    )
    return two_key_join(t.lineitem.select(*keys, "l_quantity"), stat, keys)


@query(
    "q_natural_inner",
    """SELECT c_custkey, nationkey, n_name FROM (SELECT c_custkey, c_nationkey AS nationkey FROM customer)
JOIN (SELECT n_nationkey AS nationkey, n_name FROM nation WHERE n_regionkey <> 2) USING (nationkey)""",
)
def q_natural_inner(t):
    states = t.nation.where(F.col("n_regionkey") != 2).select(F.col("n_nationkey").alias("nationkey"), "n_name")
    return natural_join(t.customer.select("c_custkey", F.col("c_nationkey").alias("nationkey")), states)


@query(
    "q_lookup",
    """SELECT l_orderkey, l_linenumber, l_partkey, p_retailprice FROM lineitem
LEFT JOIN (SELECT p_partkey AS l_partkey, p_retailprice FROM part WHERE p_size < 40) USING (l_partkey)""",
)
def q_lookup(t):
    parts = t.part.where(F.col("p_size") < 40).select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    found = lookup(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), parts, "l_partkey")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "p_retailprice")


@query(
    "q_nearest",
    f"""WITH {FIXES}
SELECT c.animal, c.fix_id AS sample_id, c.micros AS sample_micros, p.fix_id AS near_id, p.micros AS near_micros,
  p.value, abs(c.micros - p.micros) AS gap
FROM fixes c LEFT JOIN fixes p ON c.animal = p.animal AND p.kind = 'purchase'
WHERE c.kind = 'click'
QUALIFY row_number() OVER (PARTITION BY c.fix_id ORDER BY abs(c.micros - p.micros), p.micros, p.fix_id) = 1""",
)
def q_nearest(t):
    fixes = t.fixes()
    samples = fixes.where(F.col("kind") == "click").select(
        "animal", F.col("fix_id").alias("sample_id"), F.col("micros").alias("sample_micros")
    )
    targets = fixes.where(F.col("kind") == "purchase").select(
        "animal", F.col("fix_id").alias("near_id"), F.col("micros").alias("near_micros"), "value"
    )
    return nearest_in_time(
        samples, targets, "animal", "sample_id", "sample_micros", "near_micros", "near_id", ["value"]
    )


def env_points(t):
    e = F.col("event_id")
    x = F.lit(179.5) + (e * 7 % 97) / 100.0
    return t.events.select(
        "event_id",
        "user_id",
        "ts",
        F.to_date("ts").alias("time"),
        (F.lit(30.0) + (e % 100) / 100.0).alias("lat"),
        F.when(x > 180, x - 360).otherwise(x).alias("lon"),
    )


def env_grid(t):
    x = F.lit(179.5) + (F.col("l_suppkey") % 101) / 100.0
    cells = t.lineitem.select(
        F.when(F.col("l_linenumber") % 2 == 0, "sst").otherwise("wind").alias("product"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("l_orderkey") % 30).cast("int")).alias("time"),
        (F.lit(30.0) + (F.col("l_partkey") % 101) / 100.0).alias("lat"),
        F.when(x > 180, x - 360).otherwise(x).alias("lon"),
        F.col("l_quantity").alias("value"),
    )
    return cells.groupBy("product", "time", "lat", "lon").agg(F.max("value").alias("value"))


ENV = """
points AS (
  SELECT event_id, ts::date AS time, 30.0::double + (event_id % 100) / 100.0::double AS lat,
    CASE WHEN x > 180 THEN x - 360 ELSE x END AS lon
  FROM (SELECT *, 179.5::double + (event_id * 7 % 97) / 100.0::double AS x FROM events)),
grid AS (
  SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'sst' ELSE 'wind' END AS product,
    date '2024-01-01' + (l_orderkey % 30)::int AS time, 30.0::double + (l_partkey % 101) / 100.0::double AS lat,
    CASE WHEN x > 180 THEN x - 360 ELSE x END AS lon, max(l_quantity) AS value
  FROM (SELECT *, 179.5::double + (l_suppkey % 101) / 100.0::double AS x FROM lineitem) GROUP BY ALL),
seen AS (
  SELECT event_id, time, lat, lon AS x FROM points
  UNION ALL SELECT event_id, time, lat, lon + 360 FROM points WHERE lon - 0.05::double < -180
  UNION ALL SELECT event_id, time, lat, lon - 360 FROM points WHERE lon + 0.05::double > 180),
boxes AS (
  SELECT event_id, product, avg(value) AS mean, stddev_samp(value) AS stdev, median(value) AS med, count(value) AS cells
  FROM seen s JOIN grid g ON s.time = g.time AND g.lat BETWEEN s.lat - 0.05::double AND s.lat + 0.05::double
    AND g.lon BETWEEN s.x - 0.05::double AND s.x + 0.05::double
  GROUP BY event_id, product)"""


@query(
    "q_box_extract",
    f"""WITH {ENV}
SELECT event_id, product, {sql_rnd('mean')} AS mean, {sql_rnd('stdev')} AS stdev, {sql_rnd('med')} AS med, cells
FROM points LEFT JOIN boxes USING (event_id)""",
)
def q_box_extract(t):
    found = box_extract(env_points(t), env_grid(t), "event_id")
    return rounded(found.select("event_id", "product", "mean", "stdev", "med", "cells"), mean=6, stdev=6, med=6)


@query(
    "q_grid",
    f"""SELECT animal, kind, {sql_rnd('35.0::double + i * 25.0::double / 24')} AS lat, drift::double AS drift
FROM (SELECT DISTINCT user_id AS animal FROM events) CROSS JOIN generate_series(0, 24) g(i)
CROSS JOIN (VALUES ('Non-pregnant'), ('Pregnant')) s(kind) CROSS JOIN generate_series(-3, 4) d(drift)""",
)
def q_grid(t):
    animals = t.events.select(F.col("user_id").alias("animal")).distinct()
    axes = {
        "kind": ["Non-pregnant", "Pregnant"],
        "lat": axis_length_out(35.0, 60.0, 25),
        "drift": [float(v) for v in range(-3, 5)],
    }
    return rounded(expand_grid(animals, axes), lat=6)
