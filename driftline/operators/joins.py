"""Keyed, nearest-time and space-time joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.operators.skew import SLICE, range_slices


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Raise if a key repeats, so that a left join on it cannot multiply rows."""
    repeated = df.groupBy(*keys).count().where(F.col("count") > 1).limit(1).collect()
    if repeated:
        raise ValueError(f"{list(keys)} is not unique")
    return df


def day_join(left: DataFrame, right: DataFrame, key: str, day: str) -> DataFrame:
    """Left join on (animal, day).  A NULL day never matches.

    Both sides shuffle on the pair; adaptive execution splits a hot pair on
    the left and switches to a broadcast when the right turns out small.
    """
    return left.join(right, [key, day], "left")


def two_key_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "left")


def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on all shared column names; rows without a partner vanish.

    No job runs while the plan is built; adaptive execution broadcasts a side
    that turns out small.
    """
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError(f"no shared column: {left.columns} and {right.columns}")
    return left.join(right, shared, "inner")


def lookup(left: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join to a table with one row per key; :func:`assert_unique` checks that if in doubt."""
    return left.join(table, key, "left")


def nearest_in_time(
    samples: DataFrame,
    fixes: DataFrame,
    key: str,
    sample_id: str,
    sample_time: str,
    fix_time: str,
    fix_order: str,
    payload: Sequence[str],
) -> DataFrame:
    """For each sample, the fix of the same animal nearest in time, before or after.

    Ties go to the earlier fix, then to the lower ``fix_order``.  Samples and
    fixes are merged into one time line, and each sample looks back to the last
    fix and ahead to the next.  Times are numbers.  Work is linear in rows.
    """
    fix = F.struct(F.col(fix_time).alias("t"), F.col(fix_order).alias("o"), *payload)
    # One fix per animal and time: the lowest in file order.
    firsts = fixes.where(F.col(fix_time).isNotNull()).groupBy(key, F.col(fix_time).alias("_t")).agg(
        F.min_by(fix, F.col(fix_order)).alias("_fix")
    )
    no_sample = F.lit(None).cast(samples.schema[sample_id].dataType)
    line = firsts.select(key, "_t", F.lit(0).alias("_kind"), no_sample.alias("_sample"), "_fix").unionByName(
        samples.select(
            key,
            F.col(sample_time).alias("_t"),
            F.lit(1).alias("_kind"),
            F.col(sample_id).alias("_sample"),
            F.lit(None).cast(firsts.schema["_fix"].dataType).alias("_fix"),
        )
    )
    order = [F.col("_t").asc_nulls_last(), F.col("_kind").asc(), F.col("_sample").asc()]
    sliced = range_slices(line, [key], order)
    backwards = [F.col("_t").desc_nulls_first(), F.col("_kind").desc(), F.col("_sample").desc()]
    found = _look_both_ways(_lend_fixes(sliced, key), [key, SLICE], order, backwards)
    gap_before = F.col("_t") - F.col("_prev.t")
    gap_after = F.col("_next.t") - F.col("_t")
    take_prev = F.col("_next").isNull() | (gap_before <= gap_after)
    chosen = F.when(take_prev, F.col("_prev")).otherwise(F.col("_next"))
    timed = F.when(F.col("_t").isNotNull(), chosen)
    picked = found.where(F.col("_kind") == 1).withColumn("_near", timed)
    return picked.select(
        key,
        F.col("_sample").alias(sample_id),
        F.col("_t").alias(sample_time),
        F.col("_near.t").alias(fix_time),
        F.col("_near.o").alias(fix_order),
        *[F.col(f"_near.{c}").alias(c) for c in payload if c not in (fix_time, fix_order)],
        F.abs(F.col("_t") - F.col("_near.t")).alias("gap"),
    )


def _look_both_ways(
    line: DataFrame, group: Sequence[str], order: Sequence[Column], backwards: Sequence[Column]
) -> DataFrame:
    """Last fix at or before each row, and first at or after it: a running last in either direction."""
    def latest(columns: Sequence[Column]) -> Column:
        window = Window.partitionBy(*group).orderBy(*columns).rowsBetween(Window.unboundedPreceding, 0)
        return F.last("_fix", ignorenulls=True).over(window)

    return line.withColumn("_prev", latest(order)).withColumn("_next", latest(backwards))


def _lend_fixes(sliced: DataFrame, key: str) -> DataFrame:
    """Add to each slice the last fix before it and the first fix after it."""
    ends = sliced.groupBy(key, SLICE).agg(
        F.max_by("_fix", F.when(F.col("_kind") == 0, F.col("_t"))).alias("_last"),
        F.min_by("_fix", F.when(F.col("_kind") == 0, F.col("_t"))).alias("_first"),
    )
    def earlier(place: Column) -> Window:
        return Window.partitionBy(key).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)

    carried = ends.withColumn("_before", F.last("_last", ignorenulls=True).over(earlier(F.col(SLICE).asc()))).withColumn(
        "_after", F.last("_first", ignorenulls=True).over(earlier(F.col(SLICE).desc()))
    )
    lent = carried.select(key, SLICE, F.explode(F.array("_before", "_after")).alias("_fix"))
    lent = lent.where(F.col("_fix").isNotNull())
    rows = lent.select(
        key,
        F.col("_fix.t").alias("_t"),
        F.lit(0).alias("_kind"),
        F.lit(None).cast(sliced.schema["_sample"].dataType).alias("_sample"),
        "_fix",
        SLICE,
    )
    return sliced.unionByName(rows)


def box_extract(
    points: DataFrame,
    grid: DataFrame,
    point_id: str,
    time: str = "time",
    lat: str = "lat",
    lon: str = "lon",
    product: str = "product",
    value: str = "value",
    half: float = 0.05,
    wrap: bool = True,
) -> DataFrame:
    """Mean, SD and median of the grid cells in a box around each point at its time.

    Cells are bucketed at the width of a box, each distinct position visits the
    two by two buckets its box can touch, and the box test is part of that
    equi-join, so no nested-loop join is planned.  Repeated positions are looked
    up once.  ``wrap`` joins both sides of +-180.  Repeated cells of ``grid``
    (same product, time, lat, lon) are averaged first.
    """
    width = 2 * half
    spots = points.select(time, lat, lon).distinct()
    copies = [F.col(lon)]
    if wrap:
        copies = [
            F.col(lon),
            F.when(F.col(lon) - half < -180, F.col(lon) + 360),
            F.when(F.col(lon) + half > 180, F.col(lon) - 360),
        ]

    def touched(c: str) -> Column:
        return F.explode(
            F.sequence(
                F.floor((F.col(c) - half) / width).cast("bigint"),
                F.floor((F.col(c) + half) / width).cast("bigint"),
            )
        )

    visits = (
        spots.withColumn("_x", F.explode(F.array_compact(F.array(*copies))))
        .withColumn("_by", touched(lat))
        .withColumn("_bx", touched("_x"))
    )
    cells = (
        grid.where(F.col(value).isNotNull())
        .groupBy(time, F.col(lat).alias("_cy"), F.col(lon).alias("_cx"), product)
        .agg(F.avg(F.col(value).cast("double")).alias("_v"))
        .withColumn("_by", F.floor(F.col("_cy") / width).cast("bigint"))
        .withColumn("_bx", F.floor(F.col("_cx") / width).cast("bigint"))
    )
    met = visits.join(cells, [time, "_by", "_bx"]).where(
        F.col("_cy").between(F.col(lat) - half, F.col(lat) + half)
        & F.col("_cx").between(F.col("_x") - half, F.col("_x") + half)
    )
    # The values of a box are bounded by the resolution of the grid.
    summary = met.groupBy(time, lat, lon, product).agg(
        F.avg("_v").alias("mean"),
        F.stddev_samp("_v").alias("stdev"),
        F.percentile("_v", F.lit(0.5)).alias("med"),
        F.count("_v").alias("cells"),
    )
    return points.select(point_id, time, lat, lon).join(summary, [time, lat, lon], "left")


def box_columns(extracted: DataFrame, point_id: str, products: Sequence[str], product: str = "product") -> DataFrame:
    """One row per point with ``<product>_mean``, ``_stdev`` and ``_med`` columns."""
    picks = [
        F.max(F.when(F.col(product) == p, F.col(stat))).alias(f"{p}_{stat}")
        for p in products
        for stat in ("mean", "stdev", "med")
    ]
    return extracted.groupBy(point_id).agg(*picks)
