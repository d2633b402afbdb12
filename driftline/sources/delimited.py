"""Delimited text in and out: explicit schemas, decimal commas, banners and filler rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions.timeconv import parse_us_date, parse_us_minute
from driftline.operators.filters import nan_as_null

NULL_TEXT = "NA"


def read_delimited(
    spark: SparkSession,
    path,
    schema: T.StructType | str,
    sep: str = ",",
    header: bool = True,
    below: bool = False,
) -> DataFrame:
    """Read CSV with a given schema.  ``NA`` and NaN become NULL; blanks in ids are kept.

    ``below`` takes the files of all subfolders without making columns of folder names.
    """
    frame = (
        spark.read.schema(schema)
        .option("sep", sep)
        .option("header", header)
        .option("nullValue", NULL_TEXT)
        .option("encoding", "UTF-8")
        .option("recursiveFileLookup", below)
        .csv(path)
    )
    return nan_as_null(frame)


def from_decimal_comma(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), ",", ".").try_cast("double")


def to_decimal_comma(number: Column) -> Column:
    return F.regexp_replace(number.cast("string"), r"\.", ",")


def write_decimal_comma(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Semicolon-separated text with decimal commas and ``NA`` for NULL."""
    numbers = {n for n, t in df.dtypes if t in ("double", "float") or t.startswith("decimal")}
    text = df.select(
        *[to_decimal_comma(F.col(c)).alias(c) if c in numbers else F.col(c) for c in df.columns]
    )
    text.write.mode(mode).option("sep", ";").option("header", True).option("nullValue", NULL_TEXT).csv(path)


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop("all")


# Columns of the growth worksheet in file order.  The file repeats
# header names, so columns are taken by position.
WORKSHEET_COLUMNS = (
    "seal_id", "e", "exponent", "linf", "lrec", "power", "k", "partial",
    "rec_date_text", "rec_day", "t0_day", "t0_text", "t0_true_day", "t0_true_text",
)
WORKSHEET_NUMBERS = ("e", "exponent", "linf", "lrec", "power", "k", "partial")
WORKSHEET_DAYS = ("rec_day", "t0_day", "t0_true_day")


def read_growth_worksheet(spark: SparkSession, path) -> DataFrame:
    """Rows of all sections of a worksheet with banners; a row counts if its date parses."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in WORKSHEET_COLUMNS])
    raw = read_delimited(spark, path, schema, sep=";", header=False)
    rows = raw.withColumn("rec_date", parse_us_date(F.col("rec_date_text")))
    rows = rows.where(F.col("rec_date").isNotNull())
    for c in WORKSHEET_NUMBERS:
        rows = rows.withColumn(c, from_decimal_comma(F.col(c)))
    for c in WORKSHEET_DAYS:
        rows = rows.withColumn(c, F.col(c).try_cast("int"))
    return rows


def read_fix_text(spark: SparkSession, path, names: Sequence[str] = ("ptt", "time", "lat", "lon")) -> DataFrame:
    """``PTT , M/D/Y H:M , Lat , Lon`` with one header line and loose blanks."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .csv(path)
    )
    key, time, lat, lon = names
    return raw.select(
        F.col(key).alias("ptt"),
        parse_us_minute(F.col(time)).alias("time"),
        F.col(lat).try_cast("double").alias("lat"),
        F.col(lon).try_cast("double").alias("lon"),
    )
