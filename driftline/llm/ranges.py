"""Range partitioning by sampled splitters, with overfull ranges subdivided.

Rows are ordered by a pair of 64-bit keys.  A sample in which a row counts by its
size gives quantile boundaries; exact sums of all rows over the ranges follow, and
ranges that hold too much are sampled again and cut until each fits or is a
single key.  Boundaries lie between first keys, so rows that share one stay
together, unless such a group alone overfills a range; then it is cut by the
second key.  Shards are runs of ranges, and end inside a group only if that brings
them clearly nearer to equal sizes.  What reaches the driver is a sample of ``SAMPLES_PER_RANGE`` keys and one row
a range, whatever the size of the input.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.llm.common import text_bytes, written

RANGES_PER_SHARD = 256
SAMPLES_PER_RANGE = 8
EDGE_SLACK = 0.01  # of a shard, given up to keep rows with one first key together
LOWEST = -(1 << 63)
HIGHEST = (1 << 63) - 1
ROUNDS = 64


@dataclass
class Splitters:
    """Sorted boundaries; a row's range is the number of boundaries at or below its keys."""

    bounds: list[tuple[int, int]] = field(default_factory=list)

    def range_of(self, first: Column, second: Column) -> Column:
        ones = np.array([b[0] for b in self.bounds], dtype=np.int64)
        twos = np.array([b[1] for b in self.bounds], dtype=np.int64)

        @F.pandas_udf("int")
        def place(a: pd.Series, b: pd.Series) -> pd.Series:
            a, b = a.to_numpy(np.int64), b.to_numpy(np.int64)
            low, high = np.searchsorted(ones, a, "left"), np.searchsorted(ones, a, "right")
            tied = np.flatnonzero(high > low)
            out = low.copy()
            for key in np.unique(a[tied]):
                rows = tied[a[tied] == key]
                lo, hi = low[rows[0]], high[rows[0]]
                out[rows] = lo + np.searchsorted(twos[lo:hi], b[rows], "right")
            return pd.Series(out.astype(np.int32))

        return place(first, second)


def _cuts(sample: list[tuple[int, int, float]], by_second: bool, step: float) -> set[tuple[int, int]]:
    """Boundaries about every ``step`` of mass in a sorted sample."""
    cuts, gathered, last = set(), 0.0, None
    for one, two, mass in sample:
        gathered += mass
        if gathered < step:
            continue
        gathered = 0.0
        if by_second:
            cuts.add((one, two))
        else:
            cuts.add((one, LOWEST))
            if one == last and one < HIGHEST:  # heavy: gets a range of its own
                cuts.add((one + 1, LOWEST))
            last = one
    return cuts


def sampled_splitters(keys: DataFrame, ranges: int) -> tuple[Splitters, list]:
    """Boundaries for about ``ranges`` ranges of a table of ``one``, ``two`` and ``size``.

    Returns them with one row a range: ``part``, ``size`` and ``rows``.  A row's
    mass is half its share of the size and half its share of the rows, so neither
    bytes nor rows pile up in a range.
    """
    total, count = keys.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not count:
        return Splitters(), []
    mass = (F.col("size") / max(total, 1) + F.lit(1.0 / count)) / 2
    chance = (F.pmod(F.xxhash64("one", "two", F.lit("sample")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    splitters, step = Splitters(), 1.0 / ranges
    parts, wanted, share = [], None, 1.0
    for _ in range(ROUNDS):
        placed = keys if wanted is None else keys.withColumn(
            "part", splitters.range_of(F.col("one"), F.col("two"))).where(F.col("part").isin(wanted))
        wanted_samples = max(2, int(SAMPLES_PER_RANGE * ranges * min(1.0, 2 * share)))
        drawn = placed.where(chance < mass * (wanted_samples / share)).select(
            "one", "two", F.greatest(mass, F.lit(share / wanted_samples)).alias("mass"))
        sample = sorted((r.one, r.two, r.mass) for r in drawn.collect())
        single = {p.part: p.low == p.high for p in parts}
        groups: dict[int, list] = {}
        for row in sample:
            groups.setdefault(bisect_right(splitters.bounds, row[:2]), []).append(row)
        cuts = set()
        for part, rows in groups.items():
            cuts |= _cuts(rows, single.get(part, False), step)
        for p in parts:  # a range that no sample could cut is halved between its ends
            if wanted and p.part in wanted and not (cuts - set(splitters.bounds)):
                middle = (p.low + p.high) // 2 + 1, LOWEST
                cuts.add((p.low, (p.first + p.last) // 2 + 1) if single[p.part] else middle)
        splitters = Splitters(sorted(set(splitters.bounds) | cuts))
        parts = (
            keys.groupBy(splitters.range_of(F.col("one"), F.col("two")).alias("part"))
            .agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"), F.sum(mass).alias("mass"),
                 F.max("size").alias("largest"), F.min("one").alias("low"), F.max("one").alias("high"),
                 F.min("two").alias("first"), F.max("two").alias("last"))
            .orderBy("part").collect()
        )
        full = [p for p in parts if p.mass > 2 * step and (p.low, p.first) != (p.high, p.last)]
        if not full:
            break
        wanted, share = [p.part for p in full], sum(p.mass for p in full)
    return splitters, parts


def key_columns(text: Column, key: Column) -> dict[str, Column]:
    """First key: a hash of the text, so equal texts are neighbours; second: the row's key."""
    return {
        "one": F.xxhash64(F.coalesce(text, F.lit(""))),
        "two": F.coalesce(key.cast("long"), F.lit(LOWEST + 1)),
        "size": text_bytes(text) + 1,
    }


def _shard_of(parts: list, shards: int) -> list[tuple[int, int, int]]:
    """For each range: its shard, and the rows before it there.

    A shard ends at the range edge nearest to its share of the bytes, or at the
    nearest edge that parts no first key if that is hardly farther off.
    """
    total, largest = sum(p.size for p in parts), max((p.largest for p in parts), default=0)
    slack = max(EDGE_SLACK * total / shards, largest)
    edges, done = [], 0  # (bytes before the range, its place, whether it begins a first key)
    for i, p in enumerate(parts):
        edges.append((done, i, i == 0 or p.low != parts[i - 1].high))
        done += p.size
    edges.append((total, len(parts), True))
    ends = []
    for shard in range(1, shards):
        wanted = total * shard / shards
        near = min(edges, key=lambda e: abs(e[0] - wanted))
        whole = min((e for e in edges if e[2]), key=lambda e: abs(e[0] - wanted))
        ends.append((whole if abs(whole[0] - wanted) <= slack else near)[1])
    filled, out = {}, []
    for i, p in enumerate(parts):
        shard = bisect_right(ends, i)
        out.append((p.part, shard, filled.get(shard, 0)))
        filled[shard] = filled.get(shard, 0) + p.rows
    return out


def with_shards(rows: DataFrame, keys: DataFrame, shards: int) -> DataFrame:
    """Add ``shard`` and ``slot`` to rows that have the columns ``one`` and ``two``.

    ``keys`` holds the same rows' ``one``, ``two`` and ``size``.  Shards have
    nearly equal sizes; slots count from 0 in each without gaps, in key order.
    """
    splitters, parts = sampled_splitters(keys, shards * RANGES_PER_SHARD)
    spark = rows.sparkSession
    places = spark.createDataFrame(_shard_of(parts, shards), "_part int, shard int, _before long")
    placed = rows.withColumn("_part", splitters.range_of(F.col("one"), F.col("two")))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("one", "two"))
    return (
        placed.withColumn("_inside", inside)
        .join(F.broadcast(places), "_part")  # one row a range
        .withColumn("slot", F.col("_before") + F.col("_inside") - 1)
        .drop("_part", "_inside", "_before")
    )


def shard_keys(docs: DataFrame, shards: int, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every row.

    Size is the UTF-8 length plus one.  NULL texts count as empty, NULL keys come
    first.  Rows with equal texts share a shard unless a large group lies across its
    end; rows equal in text and key always do.  An empty table gives an empty table.
    """
    made = docs.select(
        F.col(key).alias("_key"), F.crc32(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("text_crc32"),
        *[c.alias(n) for n, c in key_columns(F.col(text_col), F.col(key)).items()],
    )
    keys = written(made, "keys")
    return with_shards(keys, keys.select("one", "two", "size"), shards).select(
        F.col("_key").alias(key), "size", "text_crc32", "shard", "slot")


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``shard`` and ``slot`` (columns so named are replaced)."""
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    keyed = key_columns(F.col(text_col), F.col(key))
    keys = written(docs.select(*[c.alias(n) for n, c in keyed.items()]), "keys")
    inner = [f"_own{i}" for i in range(len(own))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(own, inner, strict=True)],
                       keyed["one"].alias("one"), keyed["two"].alias("two"))
    return with_shards(rows, keys, shards).select(
        *[F.col(n).alias(c) for c, n in zip(own, inner, strict=True)], "shard", "slot")
