"""The growth chain on the whisker stand-in."""

from pyspark.sql import functions as F

from driftline.functions import growth as g
from driftline.plans.analysis import apply_overrides, date_segments
from driftline.queries.registry import WHISKERS, query, rnd, rounded, sql_rnd
from driftline.session import slice_count

RATE = "(exp(-2.052821::double) * pow({0}, -0.9204057::double))"
CHAIN = f"""
asym AS (
  SELECT *, 8.53::double - 1.96::double * (whisker_column - 4) + 2.06::double * (whisker_row - 4)
    - 0.56::double * (whisker_row - 4) * (whisker_row - 4) AS linf FROM whiskers),
share AS (
  SELECT *, CASE WHEN linf <= length_recovery THEN length_recovery ELSE linf END AS a,
    1 - CASE WHEN linf <= length_recovery THEN length_recovery / (length_recovery + 0.1::double)
             ELSE length_recovery / linf END AS left_over FROM asym),
started AS (
  SELECT * REPLACE (CASE WHEN nubbin THEN deployment_days
    ELSE CASE WHEN left_over > 0 THEN ln(left_over) END / {RATE.format('a')} + recovery_days END AS deployment_days)
  FROM share),
rated AS (
  SELECT *, CASE WHEN left_over > 0 THEN -ln(left_over) END / nullif(recovery_days - deployment_days, 0) AS k FROM started),
dated AS (
  SELECT *, CASE WHEN 1 - distance_from_tip / a > 0 THEN -ln(1 - distance_from_tip / a) END / nullif(k, 0)
    + deployment_days AS segment_days FROM rated)"""


@query(
    "q_growth_dates",
    f"""WITH {WHISKERS}, {CHAIN}
SELECT l_orderkey, l_linenumber, seal_id, {sql_rnd('linf')} AS linf, {sql_rnd('deployment_days')} AS deployment_days,
  {sql_rnd('k', 9)} AS k, {sql_rnd('segment_days')} AS segment_days,
  {sql_rnd('recovery_days - deployment_days')} AS deployment_duration,
  date '1970-01-01' + floor(segment_days)::int AS segment_date
FROM dated""",
)
def q_growth_dates(t):
    dated = date_segments(t.whiskers(), known_start_ids=[])
    picked = dated.select(
        "l_orderkey", "l_linenumber", "seal_id", "linf", "deployment_days", "k", "segment_days",
        "deployment_duration", "segment_date",
    )
    return rounded(picked, linf=6, deployment_days=6, k=9, segment_days=6, deployment_duration=6)


@query(
    "q_override",
    f"""WITH {WHISKERS}, {CHAIN},
over_rules AS (SELECT * FROM (VALUES ('3', 10000.0::double, 3.0::double), ('8', 10500.0::double, 2.5::double)) v(seal_id, known_day, known_length)),
redated AS (
  SELECT d.* REPLACE (
      CASE WHEN known_day IS NULL THEN d.deployment_days ELSE
        CASE WHEN 1 - known_length / length_recovery > 0 THEN ln(1 - known_length / length_recovery) END
        / {RATE.format('length_recovery')} + known_day END AS deployment_days,
      CASE WHEN known_day IS NULL THEN d.k ELSE {RATE.format('length_recovery')} END AS k),
    known_day
  FROM dated d LEFT JOIN over_rules USING (seal_id)),
final AS (
  SELECT *, CASE WHEN known_day IS NULL THEN segment_days
    WHEN 1 - distance_from_tip / length_recovery > 0
    THEN -ln(1 - distance_from_tip / length_recovery) / k + deployment_days END AS new_days FROM redated)
SELECT l_orderkey, l_linenumber, seal_id, {sql_rnd('deployment_days')} AS deployment_days, {sql_rnd('k', 9)} AS k,
  {sql_rnd('new_days')} AS segment_days, {sql_rnd('recovery_days - deployment_days')} AS deployment_duration FROM final""",
)
def q_override(t):
    rules = t.spark.createDataFrame(
        [("3", 10000.0, 3.0), ("8", 10500.0, 2.5)], "seal_id string, known_day double, known_length double"
    )
    dated = apply_overrides(date_segments(t.whiskers(), known_start_ids=[]), rules)
    picked = dated.select(
        "l_orderkey", "l_linenumber", "seal_id", "deployment_days", "k", "segment_days", "deployment_duration"
    )
    return rounded(picked, deployment_days=6, k=9, segment_days=6, deployment_duration=6)


@query(
    "q_growth_curve",
    f"""WITH p AS (SELECT p_partkey, 4.0::double + p_size / 5.0::double AS asymptote, p_size AS duration FROM part),
x AS (SELECT p_partkey, asymptote, unnest(generate_series(10, duration * 10)) / 10.0::double AS day FROM p)
SELECT p_partkey, day, {sql_rnd('asymptote * (1 - exp(-0.0132::double * day))')} AS length FROM x""",
)
def q_growth_curve(t):
    whisker = t.part.select(
        "p_partkey", (F.lit(4.0) + F.col("p_size") / 5.0).alias("asymptote"), F.col("p_size").alias("duration")
    )
    tenths = F.explode(F.sequence(F.lit(10), F.col("duration") * 10))
    # A part becomes hundreds of rows: the few files of parts are dealt over all tasks first.
    dealt = whisker.where(F.col("duration") >= 1).repartition(slice_count(t.spark))
    days = dealt.withColumn("tenth", tenths).withColumn("day", F.col("tenth") / 10.0)
    length = g.length_at(F.col("day"), F.col("asymptote"), F.lit(g.CURVE_RATE), F.lit(0.0))
    return days.select("p_partkey", "day", rnd(length).alias("length"))


@query(
    "q_growth_k",
    f"""SELECT l_orderkey, l_linenumber, {sql_rnd('''CASE WHEN 1 - (4.0::double + l_quantity / 5.0::double) / 12.0::double > 0
    THEN -ln(1 - (4.0::double + l_quantity / 5.0::double) / 12.0::double) END / nullif(l_tax * 1000, 0)''', 9)} AS k
FROM lineitem""",
)
def q_growth_k(t):
    k = g.rate_from_length(F.lit(4.0) + F.col("l_quantity") / 5.0, F.lit(12.0), F.col("l_tax") * 1000)
    return t.lineitem.select("l_orderkey", "l_linenumber", rnd(k, 9).alias("k"))
