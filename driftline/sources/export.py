"""Per-animal exports, routed exports and materialised intermediates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.joins import two_key_join
from driftline.operators.skew import match_keys
from driftline.session import slice_count
from driftline.sources.delimited import NULL_TEXT

ROWS_PER_FILE = 5_000_000
# Without its native library Hadoop's local file system starts a chmod process for each
# file, checksum file and folder it makes.  The plain one writes no checksum files.
# Other file systems (hdfs, s3a) are not concerned.
PLAIN_LOCAL_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def export_by_key(
    df: DataFrame,
    path: str,
    key: str,
    columns: Sequence[str] | None = None,
    mode: str = "errorifexists",
    rows_per_file: int = ROWS_PER_FILE,
) -> None:
    """One folder of CSV files per animal.

    Animals are dealt over all tasks, since most of the time goes into opening their
    folders; one with more than ``rows_per_file`` rows is spread over as many tasks
    as it has files.  The id stays inside the files, so its text is read back unchanged.  A column called ``animal``
    would be lost to the folder names and is refused.
    """
    picked = df.select(*columns) if columns else df
    if "animal" in picked.columns:
        raise ValueError("a column called animal cannot be exported")
    spark = df.sparkSession
    named = picked.withColumn("animal", F.col(key))
    sizes = named.groupBy("animal").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > rows_per_file)
    spread = match_keys(named, sizes, ["animal"], "left")
    # By content, so that a task that runs again deals its rows alike.
    piece = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in picked.columns]), F.ceil(F.col("_rows") / rows_per_file))
    (
        spread.withColumn("_piece", F.coalesce(piece, F.lit(0)))
        .repartition(slice_count(spark), "animal", "_piece")
        .drop("_rows", "_piece")
        .write.mode(mode)
        .partitionBy("animal")
        .options(**PLAIN_LOCAL_FILES)
        .option("header", True)
        .option("nullValue", NULL_TEXT)
        .option("maxRecordsPerFile", rows_per_file)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def route_by_completeness(
    meta: DataFrame,
    dive_stat: DataFrame,
    dive_type: DataFrame,
    track: DataFrame,
    key: str,
    complete: str,
    dive: str = "dive_number",
) -> tuple[DataFrame, DataFrame]:
    """Dive columns for animals with a complete dive record, the track for the others.

    Dive tables are matched on (animal, dive number), not by row order.
    """
    whole = meta.where(F.col(complete)).select(key)
    broken = meta.where(~F.col(complete)).select(key)
    dives = two_key_join(dive_stat.join(whole, key, "left_semi"), dive_type, [key, dive])
    return dives, track.join(broken, key, "left_semi")


def export_routes(dives: DataFrame, track: DataFrame, path: str, key: str) -> tuple[str, str]:
    """Write both sinks of :func:`route_by_completeness`; returns their folders."""
    folders = f"{path}/dives", f"{path}/track"
    for df, folder in zip((dives, track), folders):
        export_by_key(df, folder, key)
    return folders


def materialise(df: DataFrame, path: str, key: Sequence[str] = (), mode: str = "overwrite") -> DataFrame:
    """Write an intermediate as parquet and continue from the files."""
    kept = df.hint("rebalance", *key) if key else df
    kept.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
