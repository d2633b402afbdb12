"""The query registry and the stand-in tables the queries share.

The given tables stand in for tracks, dives and whisker segments.  Each
stand-in exists twice, as a DataFrame and as the SQL text of a CTE, with the
same column names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(prepare(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


# Means of values with two decimals often end in exactly 5 at the digit to be
# rounded; the nudge makes every engine round such ties the same way.
NUDGE = 1e-9


def rnd(value: Column | str, digits: int = 6) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column + F.lit(NUDGE), digits)


def sql_rnd(expression: str, digits: int = 6) -> str:
    return f"round(({expression}) + 1e-9::double, {digits})"


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: rnd(c, d) for c, d in digits.items()})


class Tables:
    """The given tables of one folder and the stand-ins built on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def fixes(self) -> DataFrame:
        e = F.col("event_id")
        return self.events.select(
            e.alias("fix_id"),
            F.col("user_id").alias("animal"),
            "ts",
            F.to_date("ts").alias("day"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
            F.col("event_type").alias("kind"),
            "value",
            (F.lit(30.0) + (e % 300) / 10.0).alias("lat"),
            (F.lit(-180.0) + (e * 7 % 3600) / 10.0).alias("lon"),
        )

    def whiskers(self) -> DataFrame:
        length = F.lit(4.0) + F.col("l_quantity") / 5.0
        recovery = F.unix_date(F.to_date("l_shipdate")).cast("double")
        return self.lineitem.select(
            "l_orderkey",
            "l_linenumber",
            F.col("l_suppkey").cast("string").alias("seal_id"),
            (1 + F.col("l_linenumber") % 7).alias("whisker_column"),
            (1 + F.col("l_orderkey") % 5).alias("whisker_row"),
            length.alias("length_recovery"),
            (length * (F.lit(0.1) + F.col("l_tax") * 10.0)).alias("distance_from_tip"),
            recovery.alias("recovery_days"),
            (recovery - 200.0).alias("deployment_days"),
            (F.col("l_returnflag") == "A").alias("nubbin"),
        )


FIXES = """
fixes AS (
  SELECT event_id AS fix_id, user_id AS animal, ts, ts::date AS day, epoch_us(ts) AS micros,
         event_type AS kind, value,
         30.0::double + (event_id % 300) / 10.0::double AS lat,
         -180.0::double + (event_id * 7 % 3600) / 10.0::double AS lon
  FROM events)"""

WHISKERS = """
whiskers AS (
  SELECT l_orderkey, l_linenumber, l_suppkey::varchar AS seal_id,
         1 + l_linenumber % 7 AS whisker_column, 1 + l_orderkey % 5 AS whisker_row,
         4.0::double + l_quantity / 5.0::double AS length_recovery,
         (4.0::double + l_quantity / 5.0::double) * (0.1::double + l_tax * 10.0::double) AS distance_from_tip,
         (l_shipdate::date - date '1970-01-01')::double AS recovery_days,
         (l_shipdate::date - date '1970-01-01')::double - 200.0::double AS deployment_days,
         l_returnflag = 'A' AS nubbin
  FROM lineitem)"""
