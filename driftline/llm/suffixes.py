"""Benchmark decontamination with suffix arrays over the training words.

The training texts are indexed shard by shard (a shard is what a Python worker
holds at once), the test items are searched in every shard, and nothing is
shuffled.  A shard's suffix array is sparse: training words that occur in no item
end a segment, and so do neighbouring words that no item has side by side, since
no match can cross them; segments shorter than the shortest window are left out.
The suffixes of the remaining segments are sorted together with those of the
items by doubling prefixes, and every test suffix is located by binary search.
The runs of windows found are the longest verbatim matches with their places.

The items are sent to the workers in blocks of at most ``BLOCK_BYTES`` of text; a
larger test set is searched block by block and the findings are put together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, LongType, StructField, StructType

from driftline.llm.common import alnum_words, hidden, shown, written

WINDOW = 10
BLOCK_BYTES = 32 << 20


@dataclass
class TestItems:
    """The words of the items as one array, with what is needed to skip training words fast."""

    __test__ = False
    window: int
    ids: list[int | None]
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    words: np.ndarray = None
    item_of: np.ndarray = None
    left: np.ndarray = None  # words from here to the end of the item
    pairs: np.ndarray = None
    windows: dict[int, np.ndarray] = field(default_factory=dict)  # window length -> places

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]], window: int = WINDOW) -> TestItems:
        made = cls(window, [i for i, _ in rows])
        numbers, owners, left = [], [], []
        for n, (_, text) in enumerate(rows):
            words = alnum_words(text)
            numbers += [made.vocabulary.setdefault(w, len(made.vocabulary) + 1) for w in words] + [0]
            owners += [n] * (len(words) + 1)
            left += range(len(words), -1, -1)
        made.words, made.item_of, made.left = (np.array(x, dtype=np.int64) for x in (numbers, owners, left))
        follow = made.words[:-1] * (made.words[1:] > 0) > 0 if len(numbers) > 1 else np.zeros(0, bool)
        made.pairs = np.unique(made.pair_codes(made.words)[follow]) if len(numbers) > 1 else np.zeros(0, np.int64)
        whole = made.left >= window
        made.windows = {window: np.flatnonzero(whole)} if whole.any() else {}
        first = np.flatnonzero(np.diff(made.item_of, prepend=-1)) if len(numbers) else np.zeros(0, np.int64)
        for start in first:
            size = int(made.left[start])
            if 0 < size < window:
                made.windows[size] = np.append(made.windows.get(size, np.zeros(0, np.int64)), start)
        return made

    def pair_codes(self, words: np.ndarray) -> np.ndarray:
        return words[:-1] * (len(self.vocabulary) + 1) + words[1:]


def _members(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_values, values)
    return sorted_values[np.minimum(at, len(sorted_values) - 1)] == values


def _segments(words: np.ndarray, items: TestItems, shortest: int) -> np.ndarray:
    """Places of training words in segments that can hold a match, -1 after each segment."""
    known = words > 0
    linked = np.zeros(len(words), bool)  # this word and the next can stand in one match
    if len(words) > 1:
        both = np.flatnonzero(known[:-1] & known[1:])
        linked[both] = _members(items.pairs, words[both] * (len(items.vocabulary) + 1) + words[both + 1])
    begins = np.flatnonzero(known & ~np.concatenate(([False], linked[:-1])))
    ends = np.flatnonzero(known & ~linked) + 1
    keep = ends - begins >= shortest
    begins, sizes = begins[keep], (ends - begins)[keep]
    if not len(begins):
        return np.zeros(0, np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    places = np.full(int((sizes + 1).sum()), -1, dtype=np.int64)
    offset = np.repeat(begins - starts, sizes)
    index = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)
    places[index] = index + offset
    return places


def _dense(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def _ranks(symbols: np.ndarray, depth: int) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols, up to ``depth`` or until all differ."""
    ranks, span = [_dense(symbols)], 1
    while span < depth and ranks[-1].max(initial=0) + 1 < len(symbols):
        ranks.append(_dense(_joined(ranks[-1], span)))
        span *= 2
    return ranks


def _joined(rank: np.ndarray, shift: int) -> np.ndarray:
    after = np.zeros(len(rank), dtype=np.int64)
    after[: len(rank) - shift] = rank[shift:] + 1
    return rank * (len(rank) + 1) + after


def _by_first(ranks: list[np.ndarray], words: int) -> np.ndarray:
    """Codes of the first ``words`` symbols, in suffix order."""
    level = min(words.bit_length() - 1, len(ranks) - 1)
    rest = words - (1 << level)
    return _joined(ranks[level], rest) if 0 < rest < len(ranks[level]) else ranks[level]


def search(texts: list[str | None], items: TestItems) -> list[tuple[int, list, list, int]]:
    """For every text: its words, hit stretches (start, words), items found, longest match."""
    tokens = [alnum_words(t) for t in texts]
    sizes = np.array([len(t) for t in tokens], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1  # one word of silence between texts
    words = np.zeros(int((sizes + 1).sum()), dtype=np.int64)
    number = items.vocabulary.get
    for start, own in zip(starts, tokens, strict=True):
        words[start : start + len(own)] = np.fromiter(map(number, own, repeat(0)), np.int64, len(own))
    out = [(int(n), [], [], 0) for n in sizes]
    if not items.windows:
        return out
    places = _segments(words, items, min(items.windows))
    if not len(places):
        return out

    # Suffix array of the segments, sorted together with the items' suffixes.
    train = np.where(places >= 0, words[places], 0)
    symbols = np.concatenate((train, items.words))
    silent = np.flatnonzero(symbols == 0)
    symbols[silent] = len(items.vocabulary) + 1 + np.arange(len(silent))  # no two ends are equal
    ranks = _ranks(symbols, int(items.left.max()))
    own = np.flatnonzero(places >= 0)
    array = own[np.argsort(ranks[-1][own], kind="stable")]

    found_at, found_test, found_words = [], [], []
    for size, tests in items.windows.items():
        codes = _by_first(ranks, size)
        sorted_codes, wanted = codes[array], codes[len(train) + tests]
        low, high = np.searchsorted(sorted_codes, wanted, "left"), np.searchsorted(sorted_codes, wanted, "right")
        counts = high - low
        if counts.any():
            step = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            found_at.append(places[array[np.repeat(low, counts) + step]])
            found_test.append(np.repeat(tests, counts))
            found_words.append(np.full(int(counts.sum()), size))
    if not found_at:
        return out
    at, test, size = (np.concatenate(x) for x in (found_at, found_test, found_words))

    # Windows that follow each other in text and item make one verbatim match.
    order = np.lexsort((at, items.item_of[test], at - test))
    at, test, size = at[order], test[order], size[order]
    item = items.item_of[test]
    fresh = np.concatenate(([True], (np.diff(at - test) != 0) | (np.diff(at) != 1) | (np.diff(item) != 0)))
    heads = np.flatnonzero(fresh)
    tails = np.append(heads[1:], len(at)) - 1
    begin, until = at[heads], at[tails] + size[tails]
    doc = np.searchsorted(starts, begin, "right") - 1
    for d in np.unique(doc):
        mine = doc == d
        spans = sorted({(int(b - starts[d]), int(u - starts[d])) for b, u in zip(begin[mine], until[mine], strict=True)})
        names = {items.ids[i] for i in item[heads][mine]}
        out[d] = (int(sizes[d]), _merged(spans), sorted(n for n in names if n is not None) + [None] * (None in names),
                  int((until[mine] - begin[mine]).max()))
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches (start, words) covered by sorted spans (start, end)."""
    merged: list[list[int]] = []
    for begin, end in spans:
        if merged and begin <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([begin, end])
    return [(b, e - b) for b, e in merged]


STRETCHES = ArrayType(StructType([StructField("start", IntegerType()), StructField("words", IntegerType())]))


def _finder(text: Column, shared, kind: DataType) -> Column:
    """The struct of what is found; item keys are of type ``kind``."""
    @F.pandas_udf(StructType([
        StructField("n_words", LongType()), StructField("hits", STRETCHES), StructField("items", ArrayType(kind)),
        StructField("longest", IntegerType())]))
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        items = shared.value
        for texts in batches:
            rows = search(list(texts), items)
            yield pd.DataFrame({
                "n_words": pd.Series([r[0] for r in rows], dtype="int64"),
                "hits": pd.Series([[{"start": s, "words": w} for s, w in r[1]] for r in rows], dtype=object),
                "items": pd.Series([r[2] for r in rows], dtype=object),
                "longest": pd.Series([r[3] for r in rows], dtype="int32"),
            })

    return found(text)


@F.pandas_udf(STRETCHES)
def _union(hits: pd.Series) -> pd.Series:
    return pd.Series([
        [{"start": s, "words": w} for s, w in _merged(sorted((h["start"], h["start"] + h["words"]) for h in own))]
        for own in hits
    ], dtype=object)


def with_matches(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, item_key: str = "item_id", text_col: str = "text",
    item_text: str = "text", name: str = "found", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add a struct ``found`` to every row: ``n_words``, ``hits``, ``items``, ``longest``.

    A window is ``window`` consecutive words of an item; an item with fewer words,
    but not none, is one window.  ``hits`` are the stretches of words inside any
    occurrence of a window, ``items`` the distinct keys of items with one (a NULL
    key last), ``longest`` the words of the longest match.  NULL and empty texts
    have no words and match nothing; repeated rows are found alike.
    """
    spark = docs.sparkSession
    kind = items.schema[item_key].dataType
    # Repeated items would be found alike; without them a block's size is even.
    chosen = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("text")).distinct()
    size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    if blocks == 1:
        tests = TestItems.of([tuple(r) for r in chosen.collect()], window)
        return docs.withColumn(name, _finder(F.col(text_col), spark.sparkContext.broadcast(tests), kind))
    apart = docs.drop(name)
    stored = written(apart.select(
        *hidden(apart), F.col(text_col).alias("_text"), F.monotonically_increasing_id().alias("_row")), "docs")
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    found = None
    for number in range(blocks):
        tests = TestItems.of([tuple(r) for r in chosen.where(block == number).collect()], window)
        one = stored.select("_row", _finder(F.col("_text"), spark.sparkContext.broadcast(tests), kind).alias("f"))
        one = written(one.where(F.size("f.hits") > 0), "found")
        found = one if found is None else found.union(one)
    merged = found.groupBy("_row").agg(
        _flat("f.hits").alias("hits"), F.array_sort(F.array_distinct(_flat("f.items"))).alias("items"),
        F.max("f.longest").alias("longest"))
    none = _finder(F.col("_text"), spark.sparkContext.broadcast(TestItems.of([], window)), kind)
    return (
        stored.join(merged, "_row", "left")
        .select(*shown(apart), F.struct(
            none["n_words"].alias("n_words"),
            F.coalesce(_union(F.coalesce("hits", F.array())), F.array()).alias("hits"),
            F.coalesce("items", F.array().cast(ArrayType(kind))).alias("items"),
            F.coalesce("longest", F.lit(0)).alias("longest")).alias(name))
    )


def _flat(column: str) -> Column:
    return F.flatten(F.collect_list(column))


def hit_words(found: Column) -> Column:
    return F.aggregate(found["hits"], F.lit(0).cast("long"), lambda total, h: total + h["words"])


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, as they are."""
    apart = docs.select(*hidden(docs), F.col(text_col).alias("_text"))
    clean = with_matches(apart, items, window, text_col="_text", name="_found").where(F.size("_found.hits") == 0)
    return clean.select(*shown(docs))
