"""Mixing sources to token targets by entropy balancing.

Every document gets a rate between 0 and ``CAP`` copies.  Among all rates that
give each source its target, those closest to 1 in (bounded) relative entropy are
``CAP * sigmoid(tilt * size / mean size)`` with one tilt a source; the tilts solve
the convex dual by Newton steps, each one aggregate over all documents.  Documents
of one source and size share a rate, so the steps run on counts by (source, size),
which are gathered once.

Rates become copies size by size, the largest first, carrying the words over or
under target along, so a source misses its target by about half its smallest
document.  Copies of a size are dealt over ``BUCKETS`` hash buckets and inside them
by hash order, so no group of equal documents ends in one task, and reruns agree.

Sources may be many: their numbers, targets and tilts stay in tables, and a few sums
reach the driver.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import SPACE_WORD, hidden, shown, written
from driftline.operators.skew import number_rows

CAP = 2
SHARE = 1.5
WEIGHTS = (3, 1, 2)
BUCKETS = 256
NEWTON_ROUNDS = 1100


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def with_targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Add ``target`` to rows of ``size`` and ``_place`` (from 0, in the order that deals the weights).

    Targets are a level times the weight, or ``cap`` times the size where that is less,
    and come to ``share`` times all sizes.  The level rises round by round, each one
    aggregate over the sources, until no more of them are full.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    weighed = sources.withColumn("_weight", weight)
    level, full = 0.0, -1
    while True:
        filled = F.lit(level) * F.col("_weight") > cap * F.col("size")
        row = weighed.agg(
            F.sum("size"), F.sum(F.when(filled, cap * F.col("size"))), F.sum(F.when(~filled, F.col("_weight"))),
            F.count(F.when(filled, 1))).first()
        if row[3] == full or not row[2]:
            break
        full, level = row[3], (share * row[0] - (row[1] or 0.0)) / row[2]
    target = F.least(F.lit(level) * F.col("_weight"), (cap * F.col("size")).cast("double"))
    if row[2] == 0 or row[2] is None:  # all full: each at its limit
        target = (cap * F.col("size")).cast("double")
    return weighed.withColumn("target", target).drop("_weight")


def _rate(tilt: Column, size: Column, mean: Column, cap: float) -> Column:
    slope = tilt * size / mean
    return F.when(tilt == math.inf, F.lit(float(cap))).when(
        tilt == -math.inf, F.when(size > 0, 0.0).otherwise(1.0)
    ).otherwise(cap / (1 + (cap - 1) * F.exp(-slope)))


def _tilts(cells: DataFrame, sources: DataFrame, cap: float) -> DataFrame:
    """``_s``, ``_tilt``, ``_mean`` of every source: Newton steps kept inside a bracket of the root.

    A round is one aggregate over the cells of the sources that still move; states stay
    in a table.  Steps end when a source meets its target or can move no further; after
    ``NEWTON_ROUNDS`` rounds, enough to halve a bracket to nothing, that is an error.
    """
    goal, size = F.col("target"), F.col("size")
    start = F.when(size == 0, 0.0).when(goal >= cap * size, math.inf).when(goal <= 0, -math.inf).otherwise(0.0)
    state = sources.select("_s", "size", "target", "_mean", start.alias("_tilt"),
                           F.lit(-math.inf).alias("_low"), F.lit(math.inf).alias("_high"))
    state = state.withColumn("_moving", (size > 0) & (F.abs("_tilt") < math.inf))
    for _ in range(NEWTON_ROUNDS):
        state = written(state, "tilts")
        if not state.where("_moving").limit(1).count():
            return state.select("_s", "_tilt", "_mean")
        rate = _rate(F.col("_tilt"), F.col("_size"), F.col("_mean"), cap)
        words = F.col("_count") * F.col("_size")
        sums = cells.join(state.where("_moving").select("_s", "_tilt", "_mean"), "_s").groupBy(F.col("_s").alias("_of")).agg(
            F.sum(words * rate).alias("_taken"),
            F.sum(words * rate * (1 - rate / cap) * F.col("_size") / F.col("_mean")).alias("_slope"))
        tilt, over = F.col("_tilt"), F.col("_taken") - goal
        wide = state.join(sums, F.col("_s") == F.col("_of"), "left").withColumn(
            "_moving", F.col("_moving") & (F.abs(over) > F.greatest(1e-9 * goal, F.lit(1e-6))))
        wide = wide.withColumns({
            "_high": F.when(F.col("_moving") & (over > 0), tilt).otherwise(F.col("_high")),
            "_low": F.when(F.col("_moving") & (over <= 0), tilt).otherwise(F.col("_low"))})
        newton = tilt - F.try_divide(over, F.col("_slope"))
        open_end = (F.col("_low") == -math.inf) | (F.col("_high") == math.inf)
        middle = F.when(open_end, 4 * tilt + F.when(over < 0, 1).otherwise(-1)).otherwise((F.col("_low") + F.col("_high")) / 2)
        inside = (F.col("_slope") > 0) & (newton > F.col("_low")) & (newton < F.col("_high"))
        wide = wide.withColumn("_step", F.when(inside, newton).otherwise(middle))
        state = wide.select(
            "_s", "size", "target", "_mean", F.when(F.col("_moving"), F.col("_step")).otherwise(tilt).alias("_tilt"), "_low", "_high",
            (F.col("_moving") & (F.col("_step") != tilt)).alias("_moving"))
    raise RuntimeError(f"tilts still move after {NEWTON_ROUNDS} rounds")


def _rounded(cap: int):
    """Whole copies of each size of one source: largest first, the error carried along."""
    def one_source(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("_size", ascending=False)
        carry, copies = 0.0, []
        for size, count, rate in zip(cells["_size"], cells["_count"], cells["_rate"], strict=True):
            if size == 0:
                copies.append(int(count))
                continue
            wanted = carry + count * rate * size
            n = int(min(max(round(wanted / size), 0), cap * count))
            carry = wanted - n * size
            copies.append(n)
        return pd.DataFrame({
            "_s": cells["_s"], "_size": cells["_size"], "_copies": pd.Series(copies, index=cells.index, dtype="int64"),
            "_all": cells["_count"]})

    return one_source


def with_copies(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text_col: str = "text",
    weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP,
) -> DataFrame:
    """Add ``size``, ``source_size``, ``target`` and ``copies`` to every row (columns so named are replaced).

    Size is the number of words between white space (NULL texts: 0).  Sources in
    code-point order, NULL last and a source of its own, take the weights in turn.
    Documents without words are kept once.  Repeated rows are documents of their
    own.  An empty table gives an empty table.
    """
    found = _with_copies(docs, key, source, text_col, weights, share, cap)
    made = {"size": "_size", "source_size": "_source_size", "target": "_target", "copies": "_copies"}
    own = [c for c, name in zip(shown(docs), docs.columns, strict=True) if name not in made]
    return found.select(*own, *[F.col(inner).alias(name) for name, inner in made.items()])


def _with_copies(
    docs: DataFrame, key: str, source: str, text_col: str, weights: tuple[float, ...], share: float, cap: int,
) -> DataFrame:
    """The columns of ``docs`` under private names, ``_size``, ``_source_size``, ``_target`` and ``_copies``."""
    spark = docs.sparkSession
    made = {"_size": word_count(F.col(text_col)), "_tie": F.xxhash64(F.col(key), F.col(text_col))}
    rows = written(docs.select(F.col(source).cast("string").alias("_source"), *[c.alias(n) for n, c in made.items()]), "sizes")
    per_source = rows.groupBy("_source").agg(F.sum("_size").alias("size"), F.count(F.lit(1)).alias("docs"))
    # Numbered in code-point order, NULL last, without gathering the sources.
    numbered_sources = number_rows(written(per_source, "sources"), [], [F.col("_source").asc_nulls_last()], "_no", "_all")
    sources = written(with_targets(
        numbered_sources.withColumn("_place", F.col("_no") - 1), weights, share, cap
    ).select("_source", F.col("_place").cast("int").alias("_s"), "size", "target",
             F.greatest(F.col("size") / F.col("docs"), F.lit(1e-9)).alias("_mean")), "targets")
    numbers = sources.select("_source", "_s", F.col("size").alias("_source_size"), F.col("target").alias("_target"))

    def numbered(df: DataFrame) -> DataFrame:
        # A plain join: adaptive execution sends few sources to all tasks and splits a large one.
        return df.join(numbers, df["_source"].eqNullSafe(numbers["_source"])).drop(numbers["_source"])

    bucket = F.pmod(F.col("_tie"), F.lit(BUCKETS)).cast("int")
    cells = written(
        numbered(rows).groupBy("_s", "_size", bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_count")), "cells")
    solved = _tilts(cells, sources, cap)
    by_size = cells.groupBy("_s", "_size").agg(F.sum("_count").alias("_count")).join(solved, "_s").select(
        "_s", "_size", "_count", _rate(F.col("_tilt"), F.col("_size"), F.col("_mean"), cap).alias("_rate"))
    copies = by_size.groupBy("_s").applyInPandas(_rounded(cap), "_s int, _size long, _copies long, _all long")

    inside = Window.partitionBy("_s", "_size").orderBy("_bucket")
    upto = F.sum("_count").over(inside)
    # Products of two row counts can pass 64 bits.
    dealt = lambda n: F.call_function("div", F.col("_copies").cast("decimal(38,0)") * n, F.col("_all"))
    quotas = written(
        cells.withColumn("_upto", upto).join(copies, ["_s", "_size"])
        .withColumn("_quota", dealt(F.col("_upto")) - dealt(F.col("_upto") - F.col("_count")))
        .select("_s", "_size", "_bucket", F.floor(F.col("_quota") / F.col("_count")).alias("_base"),
                (F.col("_quota") % F.col("_count")).alias("_extra")), "quotas")

    place = F.row_number().over(Window.partitionBy("_s", "_size", "_bucket").orderBy("_tie", "_place"))
    wide = docs.select(
        *hidden(docs),
        F.col(source).cast("string").alias("_source"), *[c.alias(n) for n, c in made.items()], F.col(key).alias("_place"))
    return (
        numbered(wide).withColumn("_bucket", bucket).join(quotas, ["_s", "_size", "_bucket"])
        .withColumn("_copies", F.col("_base") + (place <= F.col("_extra")).cast("long"))
        .select(*[f"_own{i}" for i in range(len(docs.columns))], "_size", "_source_size", "_target", "_copies")
    )


def mixed(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text_col: str = "text",
    weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP,
) -> DataFrame:
    """The rows of ``docs`` with all their columns as they are, each as often as the mix takes it."""
    found = _with_copies(docs, key, source, text_col, weights, share, cap).where(F.col("_copies") > 0)
    repeated = found.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return repeated.select(*shown(docs))
