"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

One pass over the texts stores two numbers a row, its length and a hash of its
first characters.  Lengths that occur once end their rows' search; of the others,
prefix hashes that occur once do.  Only rows that are left are hashed in full, in a
second pass, and grouped by that hash.

Which values occur more than once is kept as a bitmap of hashed values, in at most
``WORDS`` 64-bit words whatever the input, so it can always be broadcast and no
text is ever shuffled.  A bit shared by two values only lets a row through to the
next, finer step; the last step compares whole texts by SHA-256, so results do not
depend on the bitmap.  Groups of any size are aggregated map-side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import hidden, shown, written

PREFIX_CHARS = 64
WORDS = 1 << 20
WORD_BITS = 64


def as_it_is(text: Column) -> Column:
    return text


def _word(value: Column) -> Column:
    return F.pmod(value, F.lit(WORDS))


def _bit(value: Column) -> Column:
    return F.pmod(F.shiftright(value, 32), F.lit(WORD_BITS)).cast("int")


def _repeated(rows: DataFrame, value: str) -> DataFrame:
    """``_word``, ``_bits``: the bitmap of the values of ``value`` (hashes) held by two rows or more."""
    twice = rows.groupBy(value).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col(value)))
    return twice.groupBy(_word(F.col(value)).alias("_word")).agg(F.bit_or(bit).alias("_bits"))


def _tested(rows: DataFrame, value: str, bitmap: DataFrame, name: str) -> DataFrame:
    """Add ``name``: whether the bitmap has the value's bit.  At most ``WORDS`` rows are broadcast."""
    marked = rows.withColumn("_word", _word(F.col(value))).join(F.broadcast(bitmap), "_word", "left")
    hit = F.call_function("getbit", F.col("_bits"), _bit(F.col(value))) == 1
    return marked.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_word", "_bits")


def _refined(docs: DataFrame, text: Column, carried: list[Column]) -> DataFrame:
    """``carried`` of every row, ``_row`` and ``_full``: its whole hash, NULL if the text is alone."""
    length = F.xxhash64(F.octet_length(text))
    prefix = F.xxhash64(F.octet_length(text), F.substring(text, 1, PREFIX_CHARS))
    short = written(docs.select(length.alias("_length"), prefix.alias("_prefix")), "lengths")
    lengths = written(_repeated(short, "_length"), "by-length")
    met = _tested(short, "_length", lengths, "_met").where("_met").select("_prefix")
    prefixes = written(_repeated(met, "_prefix"), "by-prefix")
    marked = _tested(docs.select(text.alias("_text"), prefix.alias("_prefix"), *carried), "_prefix", prefixes, "_met")
    names = [c for c in marked.columns if c not in ("_text", "_prefix", "_met")]
    full = F.when(F.col("_met"), F.sha2("_text", 256))
    return written(
        marked.select(*names, full.alias("_full"), F.monotonically_increasing_id().alias("_row")), "refined")


def _decided(refined: DataFrame, key: str) -> DataFrame:
    """Add ``_top`` (row number that stays), ``_least`` (its key) and ``_size`` to rows as refined.

    Rows that are alone take no part in the shuffles.  The winner has the largest
    key; among rows with that key, or if all keys are NULL, it is some one row,
    fixed by writing the groups.
    """
    hashed = refined.where(F.col("_full").isNotNull())
    groups = written(
        hashed.groupBy(F.col("_full").alias("_group"))
        .agg(F.max_by("_row", key).alias("_named"), F.max("_row").alias("_any"), F.max(key).alias("_key_top"),
             F.count(F.lit(1)).alias("_size"))
        .where(F.col("_size") > 1)
        .select("_group", F.coalesce("_named", "_any").alias("_top"), "_key_top", "_size"), "groups")
    met = hashed.join(groups, hashed["_full"] == groups["_group"], "left").drop("_group", "_full")
    alone = refined.where(F.col("_full").isNull()).drop("_full")
    return met.unionByName(alone, allowMissingColumns=True)


def exact_groups(
    docs: DataFrame, key: str = "doc_id", text_col: str = "text",
    normal: Callable[[Column], Column] = as_it_is, digest: bool = False,
) -> DataFrame:
    """``key``, ``keep_id``, ``group_size`` and ``kept`` of every row, dropped ones too.

    Texts are equal when identical after ``normal``; NULL texts count as empty.  The
    row with the largest key stays; NULL keys lose to any other and ``keep_id`` is
    NULL where a group has no other.  Exactly one row of a group is kept, so of
    repeated rows all but one are dropped.  With ``digest``, ``text_sha256`` of the
    normalised text follows, for which every text is hashed.  An empty table gives
    an empty table.
    """
    text = normal(F.coalesce(F.col(text_col), F.lit("")))
    carried = [F.col(key).alias("_key")] + ([F.sha2(text, 256).alias("text_sha256")] if digest else [])
    done = _decided(_refined(docs, text, carried), "_key")
    return done.select(
        F.col("_key").alias(key),
        F.when(F.col("_size").isNull(), F.col("_key")).otherwise(F.col("_key_top")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_row") == F.col("_top"), F.lit(True)).alias("kept"),
        *(["text_sha256"] if digest else []),
    )


def deduplicated(
    docs: DataFrame, key: str = "doc_id", text_col: str = "text", normal: Callable[[Column], Column] = as_it_is,
) -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with all their columns as they are.

    Rows whose texts are alone are not shuffled; of the others, only row numbers
    are, and the losers' are taken out of the stored rows.
    """
    text = normal(F.coalesce(F.col(text_col), F.lit("")))
    stored = _refined(docs, text, [F.col(key).alias("_key"), *hidden(docs)])
    decided = _decided(stored.select("_key", "_row", "_full"), "_key")
    losers = decided.where(F.col("_row") != F.col("_top")).select("_row")
    return stored.join(losers, "_row", "left_anti").select(*shown(docs))
