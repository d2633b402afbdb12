"""Ordered work inside groups of any size.

Spark runs one window group in one task.  Ordered tables are therefore cut into
range slices by Spark's own range partitioner, whatever the sizes of their
groups; the slices are fixed by a checkpoint, so every later step sees the same
ones even if executors are lost.  Only per-slice totals cross slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.session import settle, slice_count

SLICE = "_slice"
# Rows of a group that look at their neighbours together.
BLOCK_ROWS = 65_536


def match_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on ``keys`` treating NULL keys as one group, keeping the left key columns."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns]
    )
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def range_slices(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Tag rows with ``_slice``: contiguous in (keys, order), a small multiple of the shuffle partitions.

    ``order`` must be total within a group, otherwise equal rows stay together.
    Slices are sorted by later windows, which spill.
    """
    ranged = df.repartitionByRange(slice_count(df.sparkSession), *[F.col(k).asc() for k in keys], *order)
    return settle(ranged.withColumn(SLICE, F.spark_partition_id()))


def slice_offsets(sliced: DataFrame, keys: Sequence[str], weight: Column, name: str) -> DataFrame:
    """Per (keys, slice): the weight in the slices before it and in the whole group."""
    group = Window.partitionBy(*keys)
    earlier = group.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    sums = sliced.groupBy(*keys, SLICE).agg(F.sum(weight).alias("_w"))
    return sums.select(
        *keys,
        SLICE,
        F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias(f"{name}_before"),
        F.col("_w").alias(f"{name}_here"),
        F.sum("_w").over(group).alias(f"{name}_total"),
    )


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "row_no",
    total: str = "group_rows",
) -> DataFrame:
    """Exact 1-based row number and group size, for groups of any size."""
    sliced = range_slices(df, keys, order)
    offsets = slice_offsets(sliced, keys, F.lit(1), "_n")
    joined = match_keys(sliced, offsets, [*keys, SLICE], "inner")
    within = F.row_number().over(Window.partitionBy(*keys, SLICE).orderBy(*order))
    return (
        joined.withColumn(name, (F.col("_n_before") + within).cast("bigint"))
        .withColumn(total, F.col("_n_total").cast("bigint"))
        .drop("_n_before", "_n_here", "_n_total", SLICE)
    )


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    column: str,
    steps: Sequence[int],
    prefix: str = "at",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``column`` of the rows ``step`` places away (negative: before) in each group.

    Rows are numbered once and groups cut into blocks of equal length; each
    block borrows the few rows it needs from its neighbours.
    """
    reach = max(abs(s) for s in steps)
    block = max(block_rows, reach)
    place = F.col("_row") - 1
    home = F.floor(place / block)
    inside = place % block
    homes = F.array(
        home,
        F.when(inside < reach, home - 1),
        F.when(inside >= block - reach, home + 1),
    )
    lent = (
        number_rows(df, keys, order, "_row", "_rows")
        .withColumn("_home", home)
        .withColumn("_block", F.explode(F.array_compact(homes)))
    )
    window = Window.partitionBy(*keys, "_block").orderBy("_row")
    shifted = lent.select("*", *[F.lead(column, s).over(window).alias(f"{prefix}{s:+d}") for s in steps])
    return shifted.where(F.col("_block") == F.col("_home")).drop("_row", "_rows", "_home", "_block")
