"""Folders of CSV files whose headers drift from file to file."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Mapping
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.sources.delimited import read_delimited

FILE = "source_file"


def trips_of_years(first: int, last: int) -> str:
    """Pattern of the seven-digit trip numbers that begin with a year from ``first`` to ``last``."""
    return rf"(?<!\d)({'|'.join(str(y) for y in range(first, last + 1))})\d{{3}}(?!\d)"


def matching_files(spark: SparkSession, folder: str, pattern: str, below: bool = False) -> DataFrame:
    """Files whose name contains a match of the regular expression, with sizes.

    ``below`` matches the whole path below ``folder`` instead, so that names of
    subfolders can select files.  Only the listing is read; file contents are not.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    if below:
        name = F.regexp_replace("path", "^.*" + re.escape(folder.rstrip("/").rsplit("/", 1)[-1]) + "/", "")
    return listed.select("path", "length", name.alias("name")).where(F.col("name").rlike(pattern))


def file_headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """First line of each file, found by one distributed scan of text lines."""
    lines = spark.read.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
    )
    first = F.min_by(F.struct("value"), "line")
    return lines.where(F.col("start") == 0).groupBy("path").agg(first.alias("f")).select("path", F.col("f.value").alias("header"))


def _as_literal_path(path: str) -> str:
    """Undo URI encoding and escape characters that path globbing would expand."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(path))


def _names(header: str, sep: str) -> tuple[str, ...]:
    return tuple(n.strip().strip('"') for n in header.lstrip("﻿").split(sep))


def read_many(
    spark: SparkSession,
    folder: str,
    pattern: str,
    types: Mapping[str, str],
    sep: str = ",",
    aliases: Mapping[str, str] | None = None,
    below: bool = False,
) -> DataFrame:
    """Read all matching files and bind their rows by column name.

    Only files that :func:`matching_files` selects are opened.  ``source_file`` is
    the name of a row's file.

    Files that share a header are read together; the groups are united by name
    with NULL for missing columns.  ``types`` gives the type of known columns
    (others are text), so an id stays text even if it looks like a number.
    ``aliases`` maps a deviating column name to the usual one.
    """
    paths = [_as_literal_path(r.path) for r in matching_files(spark, folder, pattern, below).select("path").collect()]
    if not paths:
        raise FileNotFoundError(f"no file in {folder} matches {pattern}")
    by_header: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for row in file_headers(spark, paths).collect():
        by_header[_names(row.header, sep)].append(_as_literal_path(row.path))
    frames = []
    for names, members in sorted(by_header.items()):
        schema = T.StructType(
            [T.StructField(n, T._parse_datatype_string(types.get(n, "string"))) for n in names]
        )
        frames.append(read_delimited(spark, members, schema, sep).withColumn(FILE, F.col("_metadata.file_name")))
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return repair_aliases(united, aliases or {})


def repair_aliases(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Fold a deviating column into the usual one, keeping whichever value is present."""
    for other, usual in aliases.items():
        if other in df.columns:
            value = F.coalesce(F.col(usual), F.col(other)) if usual in df.columns else F.col(other)
            df = df.withColumn(usual, value).drop(other)
    return df


def with_owner(df: DataFrame, name: str, owner: str) -> DataFrame:
    """Attach one owner id to every row."""
    return df.withColumn(name, F.lit(owner))


def year_of_trip(toppid):
    """Year prefix of a seven-digit trip number."""
    return F.substring(toppid.cast("string"), 1, 4).try_cast("int")
