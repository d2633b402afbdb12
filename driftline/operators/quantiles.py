"""Exact type-7 quantiles by group, for groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.operators.skew import SLICE, match_keys, range_slices, slice_offsets
from driftline.session import short_scans

# Plain aggregates that the counted values give without another scan.
FACTS = ("count", "mean", "min", "max")


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: Mapping[str, tuple[str, float]],
    extra: Mapping[str, tuple[str, str]] | None = None,
    approximate: bool = False,
) -> DataFrame:
    """``wanted`` maps an output name to (column, probability); ``extra`` to (column, one of ``FACTS``).

    The input is scanned once: every column's values are counted per group, with
    map-side combination, and the distinct values are ranked across range slices.
    ``approximate`` trades exactness for one mergeable sketch per group.
    """
    extra = extra or {}
    if approximate:
        plain = {"count": F.count, "mean": F.avg, "min": F.min, "max": F.max}
        facts = [plain[kind](c).alias(n) for n, (c, kind) in extra.items()]
        sketches = [F.percentile_approx(c, F.lit(p)).alias(n) for n, (c, p) in wanted.items()]
        return df.groupBy(*keys).agg(*facts, *sketches)
    number = {c: i for i, c in enumerate(sorted({c for c, _ in [*wanted.values(), *extra.values()]}))}
    values = F.array(*[
        F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for c, i in number.items()
    ])
    # NULL values weigh nothing, but keep their group in the result.
    weight = F.when(F.col("_v").isNull(), 0).otherwise(F.count(F.lit(1)))
    copies = df.select(*keys, F.inline(values)).groupBy(*keys, "_c", "_v").agg(weight.alias("_copies"))
    # The slices are settled inside, so counting sees no more rows a task however large the input is.
    with short_scans(df.sparkSession):
        sliced = range_slices(copies, [*keys, "_c"], [F.col("_v").asc()])
    facts = sliced.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), *[_fact(kind, number[c]).alias(n) for n, (c, kind) in extra.items()]
    )
    asks = [(n, number[c], p) for n, (c, p) in wanted.items()]
    return _beside(facts, _ranked(sliced, keys, asks), keys).select(*keys, *extra, *wanted)


def _fact(kind: str, number: int) -> Column:
    own = F.col("_c") == number
    held = own & (F.col("_copies") > 0)
    size = F.coalesce(F.sum(F.when(own, F.col("_copies"))), F.lit(0))
    if kind == "count":
        return size
    if kind == "mean":
        return F.try_divide(F.sum(F.when(held, F.col("_v") * F.col("_copies"))), size)
    return {"min": F.min, "max": F.max}[kind](F.when(held, F.col("_v")))


def _blend(low: Column, high: Column, place: Column) -> Column:
    share = place - F.floor(place)
    return F.when(share == 0, low).otherwise((1 - share) * low + share * high)


def _beside(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    if keys:
        return match_keys(left, right, keys, "left")
    # both sides are single rows
    return left.select("*", right.select(F.struct("*")).scalar().alias("_q")).select(
        *left.columns, "_q.*"
    )


def _ranked(sliced: DataFrame, keys: Sequence[str], asks: Sequence[tuple[str, int, float]]) -> DataFrame:
    group = [*keys, "_c"]
    offsets = slice_offsets(sliced, group, F.col("_copies"), "_n")
    every = F.array(*[
        F.struct(F.lit(n).alias("q"), F.lit(c).alias("c"), ((F.col("_n_total") - 1) * F.lit(float(p))).alias("place"))
        for n, c, p in asks
    ])

    def asked(first: Column, end: Column) -> Column:
        """Quantiles of the row's column with one of their two ranks in [first, end)."""
        return F.filter(every, lambda a: (
            (a["c"] == F.col("_c")) & (F.ceil(a["place"]) >= first) & (F.floor(a["place"]) < end)
        ))

    # Only slices that hold one of the two ranks of a quantile are looked into, each row once for all quantiles.
    here = asked(F.col("_n_before"), F.col("_n_before") + F.col("_n_here"))
    targets = offsets.where(F.size(here) > 0).drop("_n_here")
    rows = match_keys(sliced, targets, [*group, SLICE], "inner")
    running = Window.partitionBy(*group, SLICE).orderBy("_v")
    upto = F.col("_n_before") + F.sum("_copies").over(running)
    placed = (
        rows.withColumn("_upto", upto)
        .withColumn("_from", F.col("_upto") - F.col("_copies"))
        .withColumn("_ask", F.explode(asked(F.col("_from"), F.col("_upto"))))
        .withColumn("_place", F.col("_ask.place"))
        .withColumn("_lo", F.floor("_place"))
        .withColumn("_hi", F.ceil("_place"))
    )

    def value_at(rank: str) -> Column:
        holds = (F.col("_from") <= F.col(rank)) & (F.col(rank) < F.col("_upto"))
        return F.max(F.when(holds, F.col("_v")))

    ends = placed.groupBy(*keys, F.col("_ask.q").alias("_q"), "_place", "_lo", "_hi").agg(
        value_at("_lo").alias("_low"), value_at("_hi").alias("_high")
    )
    blended = _blend(F.col("_low"), F.col("_high"), F.col("_place"))
    return ends.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_q") == n, blended)).alias(n) for n, _, _ in asks]
    )
