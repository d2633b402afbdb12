"""Summaries: quantiles, trips, histograms, boxes and analysis of variance."""

from pyspark.sql import functions as F

from driftline.operators.aggregates import (
    bounding_box,
    box_outliers,
    box_stats,
    draw_summary,
    histogram,
    mass_change,
    one_way_anova,
    outer_quantiles,
    trip_extremes,
    trip_scalars,
)
from driftline.operators.grids import draws_to_long
from driftline.queries.registry import FIXES, query, rnd, rounded, sql_rnd
from driftline.queries.tails import sql_f_tail

LONG = """long AS (
  SELECT l_suppkey, 'a' AS draw, l_quantity / 10 AS value FROM lineitem
  UNION ALL SELECT l_suppkey, 'b', l_extendedprice / 20000 FROM lineitem
  UNION ALL SELECT l_suppkey, 'c', l_discount * 40 FROM lineitem)"""
LIMITS = f"""{sql_rnd('avg(value)')} AS value, {sql_rnd('quantile_cont(value, 0.025)')} AS value_lwr,
  {sql_rnd('quantile_cont(value, 0.975)')} AS value_upr"""


def draws(t):
    wide = t.lineitem.select(
        "l_suppkey",
        (F.col("l_quantity") / 10).alias("a"),
        (F.col("l_extendedprice") / 20000).alias("b"),
        (F.col("l_discount") * 40).alias("c"),
    )
    return draws_to_long(wide, ["l_suppkey"], ["a", "b", "c"], "value")


@query("q_unpivot_summary", f"WITH {LONG} SELECT l_suppkey, {LIMITS} FROM long GROUP BY l_suppkey")
def q_unpivot_summary(t):
    return rounded(draw_summary(draws(t), ["l_suppkey"], "value"), value=6, value_lwr=6, value_upr=6)


@query("q_summary_two_keys", f"WITH {LONG} SELECT l_suppkey, draw, {LIMITS} FROM long GROUP BY l_suppkey, draw")
def q_summary_two_keys(t):
    return rounded(draw_summary(draws(t), ["l_suppkey", "draw"], "value"), value=6, value_lwr=6, value_upr=6)


@query(
    "q_summary_exp",
    f"""WITH {LONG} SELECT draw, {sql_rnd('exp(avg(value))', 4)} AS value, {sql_rnd('exp(quantile_cont(value, 0.025))', 4)} AS value_lwr,
  {sql_rnd('exp(quantile_cont(value, 0.975))', 4)} AS value_upr FROM long GROUP BY draw""",
)
def q_summary_exp(t):
    summary = draw_summary(draws(t), ["draw"], "value")
    return summary.select("draw", *[rnd(F.exp(c), 4).alias(c) for c in ("value", "value_lwr", "value_upr")])


@query(
    "q_quantiles",
    f"""SELECT {sql_rnd('quantile_cont(value, 0.025)')} AS value_lwr, {sql_rnd('quantile_cont(value, 0.975)')} AS value_upr
FROM events""",
)
def q_quantiles(t):
    return rounded(outer_quantiles(t.events.select("value"), "value"), value_lwr=6, value_upr=6)


@query(
    "q_trip_scalars",
    f"""WITH {FIXES}, peak AS (SELECT animal, day FROM fixes
  QUALIFY row_number() OVER (PARTITION BY animal ORDER BY value DESC, day) = 1)
SELECT f.animal, {sql_rnd('avg(value)')} AS drift_mean, {sql_rnd('sum(value)', 4)} AS drift_sum, any_value(peak.day) AS drift_max_day
FROM fixes f JOIN peak ON f.animal = peak.animal GROUP BY f.animal""",
)
def q_trip_scalars(t):
    return rounded(trip_scalars(t.fixes(), "animal", "day", "value"), drift_mean=6, drift_sum=4)


@query(
    "q_bounding_box",
    f"""WITH {FIXES} SELECT animal, min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max
FROM fixes GROUP BY animal""",
)
def q_bounding_box(t):
    return bounding_box(t.fixes(), ["animal"], "lat", "lon")


@query(
    "q_bounding_box_all",
    f"""WITH {FIXES} SELECT min(lat) AS lat_min, max(lat) AS lat_max, min(lon) AS lon_min, max(lon) AS lon_max FROM fixes""",
)
def q_bounding_box_all(t):
    return bounding_box(t.fixes(), [], "lat", "lon")


@query(
    "q_trip_table",
    f"""WITH {FIXES}, trips AS (SELECT animal, max(lat) AS max_lat, min(lon) AS min_lon FROM fixes GROUP BY animal)
SELECT animal, max_lat, min_lon, {sql_rnd('max_lat - min_lon')} AS mass_change FROM trips""",
)
def q_trip_table(t):
    trips = trip_extremes(t.fixes(), "animal", "lat", "lon")
    return rounded(mass_change(trips, "min_lon", "max_lat"), mass_change=6)


@query(
    "q_hist",
    f"""WITH s AS (SELECT count(value) AS n, min(value) AS lo, max(value) AS hi FROM events),
c AS (SELECT *, (hi - lo) / ceil(log2(n) + 1) AS cell FROM s),
b AS (SELECT *, pow(10.0::double, floor(log10(cell))) AS base FROM c),
u AS (SELECT *, CASE WHEN NOT (2 * base - cell < 1.5::double * (cell - base)) THEN base
    WHEN NOT (5 * base - cell < 2.75::double * (cell - 2 * base)) THEN 2 * base
    WHEN NOT (10 * base - cell < 1.5::double * (cell - 5 * base)) THEN 5 * base ELSE 10 * base END AS unit FROM b),
f AS (SELECT unit, floor(lo / unit + 1e-7::double) AS first_step, ceil(hi / unit - 1e-7::double) AS last_step FROM u),
h AS (SELECT unit, first_step, first_step * unit AS start, greatest(last_step - first_step, 1)::bigint AS classes FROM f),
placed AS (SELECT greatest(1, least(classes, ceil(value / unit - 1e-7::double) - first_step))::bigint AS class_no, count(*) AS n
  FROM events, h GROUP BY 1)
SELECT g.class_no, {sql_rnd('start + (g.class_no - 1) * unit')} AS class_low, {sql_rnd('start + (g.class_no - 1) * unit + unit')} AS class_high,
  coalesce(placed.n, 0)::bigint AS n
FROM h, unnest(generate_series(1, classes)) g(class_no) LEFT JOIN placed ON placed.class_no = g.class_no""",
)
def q_hist(t):
    return rounded(histogram(t.events, "value"), class_low=6, class_high=6)


# Every value lies on a break; the SQL counts in whole hundredths.
@query(
    "q_hist_breaks",
    f"""WITH c AS (SELECT greatest(1, round(l_discount * 100)::bigint) AS class_no, count(*) AS n FROM lineitem GROUP BY 1)
SELECT g.class_no, {sql_rnd('(g.class_no - 1) / 100.0::double')} AS class_low, {sql_rnd('g.class_no / 100.0::double')} AS class_high,
  coalesce(c.n, 0)::bigint AS n FROM generate_series(1, 10) g(class_no) LEFT JOIN c ON c.class_no = g.class_no""",
)
def q_hist_breaks(t):
    return rounded(histogram(t.lineitem, "l_discount", 10), class_low=6, class_high=6)


QUARTILES = """q AS (SELECT event_type, count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.75) AS q3 FROM events GROUP BY event_type)"""
OUTSIDE = "value < q1 - 1.5::double * (q3 - q1) OR value > q3 + 1.5::double * (q3 - q1)"


@query(
    "q_boxstats",
    f"""WITH {QUARTILES}
SELECT event_type, n, {sql_rnd('q1')} AS q1, {sql_rnd('median')} AS median, {sql_rnd('q3')} AS q3,
  min(value) FILTER (NOT ({OUTSIDE})) AS whisker_low, max(value) FILTER (NOT ({OUTSIDE})) AS whisker_high,
  count(*) FILTER ({OUTSIDE}) AS outliers
FROM events JOIN q USING (event_type) GROUP BY event_type, n, q1, median, q3""",
)
def q_boxstats(t):
    return rounded(box_stats(t.events, "event_type", "value"), q1=6, median=6, q3=6)


@query(
    "q_box_outliers",
    f"WITH {QUARTILES} SELECT event_id, event_type, value FROM events JOIN q USING (event_type) WHERE {OUTSIDE}",
)
def q_box_outliers(t):
    return box_outliers(t.events.select("event_id", "event_type", "value"), "event_type", "value")


def _anova(column: str) -> str:
    # Five kinds: the degrees of freedom between them are even, as the sum of the tail wants them.
    return f"""SELECT '{column}' AS response, df_between, df_within, {sql_rnd('ss_between', 4)} AS ss_between, {sql_rnd('ss_within', 3)} AS ss_within,
  {sql_rnd('f')} AS f_value, {sql_rnd(sql_f_tail('f', 'df_between', 'df_within'))} AS p_value
FROM (SELECT *, (ss_between / df_between) / (ss_within / df_within) AS f FROM (
  SELECT (count(*) - 1)::bigint AS df_between, (sum(n) - count(*))::bigint AS df_within, sum(n * (m - g) * (m - g)) AS ss_between, sum(n * v) AS ss_within
  FROM (SELECT kind, count(*) AS n, avg({column}) AS m, var_pop({column}) AS v FROM fixes GROUP BY kind),
    (SELECT avg({column}) AS g FROM fixes)))"""


@query("q_anova", f"WITH {FIXES} {_anova('value')} UNION ALL {_anova('lat')}")
def q_anova(t):
    return rounded(one_way_anova(t.fixes(), "kind", ["value", "lat"]), ss_between=4, ss_within=3, f_value=6, p_value=6)
