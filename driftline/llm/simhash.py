"""Near-duplicates by SimHash fingerprints and pivot distance tables.

Each distinct fingerprint gets one row of a pivot table: its Hamming distances
to ``PIVOTS`` reference fingerprints, kept for each of four 16-bit blocks.  Two
fingerprints that differ in at most two bits agree on two blocks at least, and
there all their pivot distances agree.  So only rows with equal distances on a
pair of blocks meet (an equi-join, six keys a fingerprint); of those, pairs whose
whole distances to some pivot differ by more than two are discarded by the
triangle inequality, and the survivors are verified bit by bit.  No link is lost.

Documents with one fingerprint are reduced to one row before any pair is made,
and a fingerprint has at most 2,080 others within two bits, so links cannot grow
with the square of a group.  Links are then followed to components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from driftline.llm.common import hidden, shown, space_words, written
from driftline.llm.components import smallest_reachable

SHINGLE_WORDS = 3
HASH_SEED = 42
MAX_BITS = 2
PIVOTS = 9
BLOCKS = 4
BITS = 64
_SLAB = 1 << 16


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


# Reference fingerprints: hashes of their numbers.
REFERENCES = [_signed(xxhash.xxh64_intdigest(b"pivot %d" % j)) for j in range(PIVOTS)]


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """The signed 64-bit SimHash of a whole text; 0 if it has no words."""
    words = space_words(text)
    if not words:
        return 0
    if len(words) < width:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        shingles, n = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)), len(words) - width + 1
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(HASH_SEED))
    values = np.fromiter(hashes, dtype="<u8", count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, n, _SLAB):
        octets = values[start : start + _SLAB].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint(t) for t in texts], dtype="int64")


def as_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def pivot_table(prints: DataFrame, column: str = "fingerprint") -> DataFrame:
    """One row per distinct fingerprint: ``block0``-``block3`` hold the packed distances
    on a block (5 bits a pivot), ``whole`` those on all bits (7 bits a pivot)."""
    value = F.col("print")
    width = BITS // BLOCKS
    near = [
        [F.bit_count(value.bitwiseXOR(F.lit(p)).bitwiseAND(F.lit(_signed(((1 << width) - 1) << (width * b))))).cast("long")
         for p in REFERENCES]
        for b in range(BLOCKS)
    ]
    pack = lambda parts, bits: reduce(
        lambda a, b: a + b, [F.shiftleft(d, bits * j) for j, d in enumerate(parts)])
    return (
        prints.where(F.col(column).isNotNull()).select(F.col(column).alias("print")).distinct()
        .select("print", *[pack(near[b], 5).alias(f"block{b}") for b in range(BLOCKS)])
        .select("*", pack([_unpacked(j) for j in range(PIVOTS)], 7).alias("whole"))
    )


def _unpacked(j: int) -> Column:
    """The whole distance to pivot ``j``: its block distances added up."""
    return reduce(lambda a, b: a + b, [
        F.shiftright(F.col(f"block{b}"), 5 * j).bitwiseAND(F.lit(31)) for b in range(BLOCKS)])


def links(table: DataFrame) -> DataFrame:
    """``u``, ``v``: every pair of distinct fingerprints at most ``MAX_BITS`` bits apart, once."""
    keys = F.array(*[
        F.struct(F.lit(n).alias("part"), F.col(f"block{a}").alias("one"), F.col(f"block{b}").alias("two"))
        for n, (a, b) in enumerate(combinations(range(BLOCKS), 2))
    ])
    rows = table.select("print", "whole", F.inline(keys))
    left, right = rows.alias("l"), rows.alias("r")
    coordinate = lambda side, j: F.shiftright(F.col(f"{side}.whole"), 7 * j).bitwiseAND(F.lit(127))
    apart = F.greatest(*[F.abs(coordinate("l", j) - coordinate("r", j)) for j in range(PIVOTS)])
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in ("part", "one", "two")]
    met = left.join(right, [
        *on, F.col("l.print") < F.col("r.print"), apart <= MAX_BITS,
        F.bit_count(F.col("l.print").bitwiseXOR(F.col("r.print"))) <= MAX_BITS,
    ])
    return met.select(F.col("l.print").alias("u"), F.col("r.print").alias("v")).distinct()


def print_components(prints: DataFrame) -> DataFrame:
    """``print``, ``root``: every linked fingerprint and the smallest one it can reach."""
    return smallest_reachable(links(pivot_table(prints)), "u", "v").select(F.col("node").alias("print"), "root")


def _least_of_component(prints: DataFrame, value: str) -> DataFrame:
    """``_print`` and ``_least``: for each fingerprint, the least ``value`` in its component.

    Rows of one fingerprint are first reduced to one, with map-side combination.
    """
    own = prints.groupBy("fingerprint").agg(F.min(value).alias("_own"))
    roots = print_components(prints)
    named = own.join(roots, own["fingerprint"] == roots["print"], "left").select(
        "fingerprint", "_own", F.coalesce("root", "fingerprint").alias("_root"))
    least = named.groupBy("_root").agg(F.min("_own").alias("_least"))
    return written(named.join(least, "_root").select(F.col("fingerprint").alias("_print"), "_least"), "components")


def with_components(prints: DataFrame, key: str = "doc_id") -> DataFrame:
    """Add ``component_id`` to rows of ``key`` and ``fingerprint``: the smallest key reachable.

    Repeated rows and texts share a component; NULL keys are members but never
    name one (a component of NULL keys alone has a NULL id).  No rows give none.
    """
    named = _least_of_component(prints, key).withColumnRenamed("_least", "component_id")
    return prints.join(named, prints["fingerprint"] == named["_print"]).drop("_print")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key``, ``fingerprint`` (long) and ``component_id`` of every row of ``docs``."""
    prints = written(docs.select(key, fingerprints(F.col(text_col)).alias("fingerprint")), "prints")
    return with_components(prints, key)


def one_of_each(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one of each component: that of the smallest key.

    NULL keys come last, and among repeated rows the first in the stored table
    stays.  All columns are returned as they are.
    """
    stored = written(docs.select(
        *hidden(docs), F.col(key).alias("_key"), F.monotonically_increasing_id().alias("_row"),
        fingerprints(F.col(text_col)).alias("_print")), "tagged")
    rows = stored.select("_row", F.col("_print").alias("fingerprint"),
                         F.struct(F.col("_key").isNull().alias("missing"), F.col("_key").alias("key"), "_row").alias("_rank"))
    first = _least_of_component(rows, "_rank")
    losers = rows.join(first, rows["fingerprint"] == first["_print"]).where(
        F.col("_row") != F.col("_least._row")).select("_row")
    return stored.join(losers, "_row", "left_anti").select(*shown(docs))
