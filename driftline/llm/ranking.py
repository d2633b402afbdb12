"""Ranked lexical search by dense blocked matrix products.

One pass turns every document into the numbers of the items' terms it holds and
how often, stored as arrays; N, L and the document frequencies are aggregated from
that table.  The second pass multiplies, tile by tile, item weights (items x terms
of that tile's items) by document impacts (terms x documents) with BLAS.  All
factors are integers kept in float64: a tile has at most ``TILE_TERMS`` terms, so
that sums of weight x impact stay below 2^53 and are exact in any order; pieces of
longer items are added up as 64-bit integers.

Per item a worker keeps its best ``k`` so far and takes from a tile every document
that reaches the last of them, ties included, before it cuts again by (score, key).
What is shuffled is ``k`` rows an item and task.

Items with one text are searched once.  They go to the workers in blocks of about
``BLOCK_BYTES`` of distinct item text; a larger set is searched block by block,
each block against all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from driftline.llm.common import alnum_words, written

TOP = 50
BLOCK_BYTES = 8 << 20
TILE_ITEMS = 64
TILE_TERMS = 2048
SALTS = 64
UNIT = 1_000_000_000  # scale of an impact's numerator
FULL = 1 << 53
LENGTH_PART = 50  # of 100: how much a document's length counts


@dataclass
class Block:
    """Distinct item texts as sorted arrays of term numbers, and the number of every term."""

    items: list[tuple[int, np.ndarray]]
    vocabulary: dict[bytes, int]

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Block:
        vocabulary: dict[bytes, int] = {}
        items = []
        for number, text in rows:
            terms = sorted({vocabulary.setdefault(w, len(vocabulary)) for w in alnum_words(text)})
            if terms:
                items.append((number, np.array(terms, dtype=np.int64)))
        return cls(items, vocabulary)

    def tiles(self, weights: np.ndarray) -> list[tuple[list[int], list[tuple[np.ndarray, np.ndarray]]]]:
        """Groups of items (their places), each with pieces: term numbers and weights (items x terms)."""
        made = []
        for first in range(0, len(self.items), TILE_ITEMS):
            own = self.items[first : first + TILE_ITEMS]
            terms = np.unique(np.concatenate([t for _, t in own]))
            pieces = []
            for at in range(0, len(terms), TILE_TERMS):
                some = terms[at : at + TILE_TERMS]
                table = np.zeros((len(own), len(some)))
                for row, (_, t) in enumerate(own):
                    held = np.isin(some, t, assume_unique=True)
                    table[row, held] = weights[some[held]]
                if table.sum(axis=1).max(initial=0) * (UNIT // 1000) >= FULL:
                    raise ValueError("weights too large for exact sums")
                pieces.append((some, table))
            made.append((list(range(first, first + len(own))), pieces))
        return made


def term_weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _arrow_ints(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def held_terms(docs: DataFrame, vocabulary, key: str, text_col: str) -> DataFrame:
    """``key``, ``n`` (terms with repeats), ``ids``, ``tfs`` of every document with a term.

    ``vocabulary`` is a broadcast dict of terms; only its terms are listed.
    """
    ints = ArrayType(IntegerType())
    schema = StructType([StructField("key", docs.schema[key].dataType), StructField("n", LongType()),
                         StructField("ids", ints), StructField("tfs", ints)])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = vocabulary.value.get, max(len(vocabulary.value), 1)
        for batch in batches:
            lengths, codes = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = alnum_words(text)
                lengths.append(len(words))
                found = np.fromiter(map(number, words, repeat(-1)), np.int64, len(words))
                codes.append(found[found >= 0] + i * size)
            pairs, tfs = np.unique(np.concatenate(codes or [np.zeros(0, np.int64)]), return_counts=True)
            offsets = np.searchsorted(pairs, np.arange(len(lengths) + 1) * size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), _arrow_ints(pairs % size, offsets),
                 _arrow_ints(tfs, offsets)], names=["key", "n", "ids", "tfs"])

    chosen = docs.select(F.col(key).alias("key"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(held, schema).where(F.col("n") > 0)


def length_parts(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m of documents with ``n`` terms; Python integers, since n * N may pass 64 bits."""
    values, back = np.unique(n, return_inverse=True)
    parts = [100 - LENGTH_PART + LENGTH_PART * int(v) * docs // total for v in values]
    return np.array(parts, dtype=np.int64)[back]


class _Best:
    """The best ``k`` (score, key) of one item so far, by descending score and ascending key, NULL last."""

    def __init__(self, k: int):
        self.k, self.rows, self.least = k, [], 1

    def add(self, scores: np.ndarray, keys: list) -> None:
        place = np.flatnonzero(scores >= self.least)
        if not len(place):
            return
        if len(place) > self.k:  # only the tile's own best can stay; ties at its last place all go on
            last = np.partition(scores[place], len(place) - self.k)[len(place) - self.k]
            place = place[scores[place] >= last]
        new = [(-int(scores[p]), keys[p] is None, keys[p]) for p in place]
        self.rows = sorted(self.rows + new, key=_in_order)[: self.k]
        if len(self.rows) == self.k:
            self.least = -self.rows[-1][0]


def _in_order(row: tuple) -> tuple:
    return row if row[2] is not None else (row[0], True, 0)


def best_of(held: DataFrame, block, weights, docs: int, total: int, k: int) -> DataFrame:
    """``item`` (number), ``key``, ``score``: the best ``k`` documents an item and task."""
    schema = StructType([StructField("item", LongType()), held.schema["key"], StructField("score", LongType())])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = block.value
        tiles = own.tiles(weights.value)
        look = np.full(len(own.vocabulary), -1, dtype=np.int64)
        best = [_Best(k) for _ in own.items]
        kind = None
        for batch in batches:
            kind = batch.schema.field("key").type
            keys = batch.column(0).to_pylist()
            m = length_parts(batch.column(1).to_numpy(), docs, total)
            ids, tfs = batch.column(2), batch.column(3)
            doc = np.repeat(np.arange(len(keys)), ids.value_lengths().to_numpy())
            ids, tfs = ids.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64)
            impact = ((UNIT * tfs) // (1000 * tfs + 20 * m[doc])).astype(float)
            for places, pieces in tiles:
                scores = np.zeros((len(places), len(keys)), dtype=np.int64)
                for terms, table in pieces:
                    look[terms] = np.arange(len(terms))
                    row = look[ids]
                    here = row >= 0
                    look[terms] = -1
                    if here.any():
                        dense = np.zeros((len(terms), len(keys)))
                        dense[row[here], doc[here]] = impact[here]
                        scores += (table @ dense).astype(np.int64)
                for place, line in zip(places, scores, strict=True):
                    best[place].add(line, keys)
        made = [(number, key, -score) for (number, _), b in zip(own.items, best, strict=True) for score, _, key in b.rows]
        if made:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in made], pa.int64()), pa.array([r[1] for r in made], kind),
                 pa.array([r[2] for r in made], pa.int64())], names=["item", "key", "score"])

    return held.mapInArrow(multiply, schema)


def ranked(
    docs: DataFrame, items: DataFrame, k: int = TOP, key: str = "doc_id", text_col: str = "text",
    item_key: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``item_key``, ``rank``, ``key``, ``score``: every item's ``k`` highest-scoring documents.

    Terms are the alphanumeric words of whole texts, A-Z lower-cased.  Scores are
    integers; only those above 0 are returned, equal ones by ascending key (NULL
    last).  NULL and empty texts have no terms: such documents count nowhere, such
    items have no rows.  Repeated rows are documents, or items, of their own; equal
    rows share their ranks in any order.  An empty table of either gives no rows.
    """
    spark = docs.sparkSession
    texts = items.where(F.col(item_text).isNotNull()).select(F.col(item_text).alias("_text")).distinct()
    stored = written(texts.withColumn("_item", F.monotonically_increasing_id()), "item-texts")
    size = stored.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    tops, totals = [], None
    for number in range(blocks):
        chosen = stored.where(F.pmod(F.xxhash64("_text"), F.lit(blocks)) == number)
        block = Block.of([(r["_item"], r["_text"]) for r in chosen.collect()])  # about ``block_bytes`` of text
        if not block.items:
            continue
        words = spark.sparkContext.broadcast(block.vocabulary)
        held = written(held_terms(docs, words, key, text_col), "held")
        if totals is None:
            totals = held.agg(F.count(F.lit(1)), F.sum("n")).first()
        counted = held.select(F.explode("ids").alias("id")).groupBy("id").count().collect()  # a row a term of the block
        weights = np.full(len(block.vocabulary), term_weight(totals[0], 0), dtype=np.float64)
        for row in counted:
            weights[row["id"]] = term_weight(totals[0], row["count"])
        shared = [spark.sparkContext.broadcast(x) for x in (block, weights)]
        best = best_of(held, *shared, totals[0], totals[1] or 1, k)
        tops.append(written(_cut(_cut(best, k, "item", F.pmod(F.xxhash64("key"), F.lit(SALTS))), k, "item"), "best"))
    kind = docs.schema[key].dataType
    if not tops:
        empty = StructType([items.schema[item_key], StructField("rank", LongType()), StructField(key, kind),
                            StructField("score", LongType())])
        return spark.createDataFrame([], empty).withColumn("rank", F.col("rank").cast("int"))
    top = tops[0]
    for more in tops[1:]:
        top = top.union(more)
    named = items.select(F.col(item_key).alias("_id"), F.col(item_text).alias("_own")).join(
        stored, F.col("_own") == F.col("_text")).select("_id", "_item")
    return top.join(named, top["item"] == named["_item"]).select(
        F.col("_id").alias(item_key), "rank", F.col("key").alias(key), "score")


def _cut(rows: DataFrame, k: int, *groups) -> DataFrame:
    order = Window.partitionBy(*groups).orderBy(F.desc("score"), F.asc_nulls_last("key"))
    kept = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return kept
