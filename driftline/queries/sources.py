"""Text sources and sinks: the given tables are written out and read back.

Files go to the shared scratch folder of the session under a fresh name.
"""

from pyspark.sql import functions as F

from driftline.functions.timeconv import parse_dashed_date, serial_to_date
from driftline.queries.registry import FIXES, query, rnd, rounded, sql_rnd
from driftline.session import scratch_path
from driftline.sources.delimited import (
    from_decimal_comma,
    read_delimited,
    read_fix_text,
    read_growth_worksheet,
    write_decimal_comma,
)
from driftline.sources.export import export_by_key, export_routes, materialise, route_by_completeness
from driftline.sources.multifile import FILE, read_many, repair_aliases, trips_of_years, with_owner, year_of_trip

TRACK_TYPES = {"JulDate": "double", "Lat": "double", "Lon": "double", "Long": "double", "FixID": "bigint"}


def raw_track(t):
    return t.fixes().select(
        F.col("fix_id").alias("FixID"),
        F.col("animal").cast("string").alias("SealID"),
        (F.col("micros") / 86400000000.0 + 719529).alias("JulDate"),
        F.date_format("day", "d-MMM-yyyy").alias("DateUTC"),
        F.col("lat").alias("Lat"),
        F.col("lon").alias("Lon"),
    )


def write_csv(df, path):
    df.write.option("header", True).csv(path)


@query(
    "q_ingest_drift",
    f"""WITH {FIXES} SELECT fix_id, animal::varchar AS seal_id, day, CASE WHEN fix_id % 2 = 1 THEN day END AS text_day, lat, lon FROM fixes""",
)
def q_ingest_drift(t):
    track = raw_track(t)
    folder = scratch_path(t.spark, "tracks")
    odd = F.col("FixID") % 2 == 1
    write_csv(track.where(~odd).select("FixID", "SealID", "JulDate", "Lat", "Lon"), f"{folder}/Track_Best_a")
    longer = track.where(odd).withColumnRenamed("Lon", "Long")
    write_csv(longer.select("SealID", "DateUTC", "JulDate", "Lat", "Long", "FixID"), f"{folder}/Track_Best_b")
    united = read_many(t.spark, folder, r"^part-.*\.csv$", TRACK_TYPES, aliases={"Long": "Lon"})
    return united.select(
        F.col("FixID").alias("fix_id"),
        F.col("SealID").alias("seal_id"),
        serial_to_date(F.col("JulDate")).alias("day"),
        parse_dashed_date(F.col("DateUTC")).alias("text_day"),
        F.col("Lat").alias("lat"),
        F.col("Lon").alias("lon"),
    )


@query(
    "q_alias_repair",
    f"""WITH {FIXES} SELECT fix_id, 'deployment' AS owner, lon FROM fixes""",
)
def q_alias_repair(t):
    a = t.fixes().where(F.col("fix_id") % 2 == 0).select("fix_id", "lon")
    b = t.fixes().where(F.col("fix_id") % 2 == 1).select("fix_id", F.col("lon").alias("long"))
    united = repair_aliases(a.unionByName(b, allowMissingColumns=True), {"long": "lon"})
    return with_owner(united, "owner", "deployment").select("fix_id", "owner", "lon")


@query(
    "q_fix_text",
    f"""WITH {FIXES} SELECT animal::varchar AS ptt, date_trunc('minute', ts) AS time, lat, lon FROM fixes""",
)
def q_fix_text(t):
    path = scratch_path(t.spark, "unfiltered")
    text = t.fixes().select(
        F.col("animal").cast("string").alias("PTT "),
        F.concat(F.lit(" "), F.date_format("ts", "M/d/yyyy H:mm"), F.lit(" ")).alias(" Date "),
        F.concat(F.lit(" "), F.col("lat").cast("string")).alias(" Latitude"),
        F.concat(F.lit(" "), F.col("lon").cast("string")).alias(" Longitude"),
    )
    write_csv(text, path)
    fixes = read_fix_text(t.spark, path)
    return fixes.select("ptt", F.col("time").cast("timestamp_ntz").alias("time"), "lat", "lon")


@query(
    "q_decimal_comma",
    """SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_tax > 0 THEN l_tax END AS l_tax FROM lineitem""",
)
def q_decimal_comma(t):
    path = scratch_path(t.spark, "comma")
    gaps = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_extendedprice", F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("l_tax")
    )
    write_decimal_comma(gaps, path)
    text = read_delimited(
        t.spark, path, "l_orderkey bigint, l_linenumber int, l_extendedprice string, l_tax string", sep=";"
    )
    numbers = {c: from_decimal_comma(F.col(c)) for c in ("l_extendedprice", "l_tax")}
    return text.withColumns(numbers)


@query(
    "q_export_by_animal",
    f"""WITH {FIXES}, d AS (SELECT animal::varchar AS seal_id, count(*) AS n, sum(lat) AS lat, min(fix_id) AS first_id FROM fixes GROUP BY animal)
SELECT seal_id, n, {sql_rnd('lat', 4)} AS lat_sum, first_id FROM d""",
)
def q_export_by_animal(t):
    path = scratch_path(t.spark, "export")
    export_by_key(raw_track(t), path, "SealID", ["FixID", "SealID", "JulDate", "Lat", "Lon"])
    back = read_delimited(t.spark, path, "FixID bigint, SealID string, JulDate double, Lat double, Lon double", below=True)
    totals = back.groupBy(F.col("SealID").alias("seal_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("Lat").alias("lat_sum"), F.min("FixID").alias("first_id")
    )
    return rounded(totals, lat_sum=4)


@query(
    "q_materialise",
    f"""WITH {FIXES} SELECT animal, day, {sql_rnd('avg(value)')} AS value FROM fixes GROUP BY animal, day""",
)
def q_materialise(t):
    daily = t.fixes().groupBy("animal", "day").agg(rnd(F.avg("value")).alias("value"))
    return materialise(daily, scratch_path(t.spark, "daily"), ["animal"])


@query(
    "q_conditional_export",
    f"""WITH {FIXES}, whole AS (SELECT DISTINCT animal, animal % 3 <> 0 AS complete FROM fixes)
SELECT 'dives' AS route, animal, fix_id, value, CASE WHEN kind <> 'error' THEN day END AS day FROM fixes JOIN whole USING (animal) WHERE complete
UNION ALL SELECT 'track', animal, fix_id, NULL, day FROM fixes JOIN whole USING (animal) WHERE NOT complete""",
)
def q_conditional_export(t):
    fixes = t.fixes()
    meta = fixes.select("animal").distinct().withColumn("complete", F.col("animal") % 3 != 0)
    dive_stat = fixes.select("animal", F.col("fix_id").alias("dive_number"), "value")
    dive_type = fixes.where(F.col("kind") != "error").select("animal", F.col("fix_id").alias("dive_number"), "day")
    track = fixes.select("animal", "fix_id", "day")
    renamed = [d.withColumnRenamed("animal", "seal") for d in (meta, dive_stat, dive_type, track)]
    sinks = export_routes(*route_by_completeness(*renamed, "seal", "complete"), scratch_path(t.spark, "routes"), "seal")
    kind = meta.schema["animal"].dataType.simpleString()
    dives = read_delimited(t.spark, sinks[0], f"seal {kind}, dive_number bigint, value double, day date", below=True)
    others = read_delimited(t.spark, sinks[1], f"seal {kind}, fix_id bigint, day date", below=True)
    animal = F.col("seal").alias("animal")
    return dives.select(
        F.lit("dives").alias("route"), animal, F.col("dive_number").alias("fix_id"), "value", "day"
    ).unionByName(others.select(F.lit("track").alias("route"), animal, "fix_id", "day"), allowMissingColumns=True)


# One banner, header or filler line for each row, and the rows themselves with decimal commas.
@query(
    "q_worksheet",
    """SELECT l_suppkey::varchar AS seal_id, l_quantity / 5 AS lrec, l_shipdate::date AS rec_date,
  (l_shipdate::date - date '1970-01-01')::int AS rec_day FROM lineitem""",
)
def q_worksheet(t):
    path = scratch_path(t.spark, "worksheet")
    day = F.to_date("l_shipdate")
    comma = F.regexp_replace((F.col("l_quantity") / 5).cast("string"), r"\.", ",")
    row = F.concat_ws(
        ";", F.col("l_suppkey").cast("string"), F.lit("2,7;-0,1;14,41"), comma, F.lit("1;0,01;0,5"),
        F.date_format(day, "M/d/yyyy"), F.unix_date(day).cast("string"), F.lit("1;1/1/1970;;"),
    )
    filler = F.when(F.col("l_linenumber") == 1, "Growth model;;;;;;;;;;;;;").when(
        F.col("l_linenumber") == 2, "SealID;e;exponent;Linf;Lrec;power;K;partial;RecDate;RecDay;T0;T0;T0;T0"
    ).otherwise(";;;;;;;;;;;;;")
    t.lineitem.select(F.explode(F.array(filler, row)).alias("value")).write.text(path)
    return read_growth_worksheet(t.spark, path).select("seal_id", "lrec", "rec_date", "rec_day")


@query(
    "q_trip_year",
    f"""WITH {FIXES}, trips AS (SELECT fix_id, 2000 + animal % 20 AS year FROM fixes)
SELECT year::int AS year, count(*) AS n, min(fix_id) AS first_id FROM trips WHERE year BETWEEN 2004 AND 2015 GROUP BY year""",
)
def q_trip_year(t):
    number = (2000 + F.col("animal") % 20) * 1000 + F.col("animal") % 1000
    year = year_of_trip(number.cast("int"))
    trips = t.fixes().withColumn("year", year).where(F.col("year").between(2004, 2015))
    return trips.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.min("fix_id").alias("first_id"))


@query(
    "q_trip_files",
    f"""WITH {FIXES}, trips AS (SELECT fix_id, lat, (2000 + animal % 20) * 1000 + 7 AS trip FROM fixes)
SELECT trip::int AS trip, count(*) AS n, 1 AS files, min(fix_id) AS first_id, {sql_rnd('max(lat)')} AS max_lat
FROM trips WHERE trip BETWEEN 2004000 AND 2015999 GROUP BY trip""",
)
def q_trip_files(t):
    """One file a trip is written; those of other years are never opened."""
    folder = scratch_path(t.spark, "trips")
    trip = (2000 + F.col("animal") % 20) * 1000 + 7
    fixes = t.fixes().select("fix_id", "lat", trip.cast("int").alias("trip"), trip.alias("folder"))
    fixes.repartition("folder").write.partitionBy("folder").option("header", True).csv(folder)
    rows = read_many(t.spark, folder, "^folder=" + trips_of_years(2004, 2015), {"fix_id": "bigint", "lat": "double", "trip": "int"}, below=True)
    return rows.groupBy("trip").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(FILE).cast("int").alias("files"),
        F.min("fix_id").alias("first_id"), rnd(F.max("lat")).alias("max_lat"))


@query(
    "q_first_rows",
    f"""WITH {FIXES} SELECT fix_id, {sql_rnd('max(value) OVER ()')} AS peak FROM fixes ORDER BY ts, fix_id LIMIT 6""",
)
def q_first_rows(t):
    peak = t.fixes().agg(F.max("value")).scalar()
    return t.fixes().withColumn("peak", rnd(peak)).orderBy("ts", "fix_id").limit(6).select("fix_id", "peak")
