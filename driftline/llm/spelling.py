"""Spelling variants by reduced alphabets.

Every letter is hashed to one of a few symbols.  If two words are one edit apart,
their reduced words are at most one edit apart; so the full one-edit neighbourhood
of every reduced word (itself, all deletions, insertions and replacements over the
few symbols) is joined to the reduced vocabulary, and the pairs that meet are
verified on the original words.  No pair is lost and none is made twice.

A bitmap of the reduced vocabulary, of bounded size and broadcast, drops neighbours that
are no reduced word before they are shuffled; a full bitmap only lets more through.

Reduced words travel as 64-bit hashes, a sum over places of symbol code times an
odd power, from which the hash of every neighbour follows by a few additions; two
reduced words with one hash only cost a verification.  The number of symbols grows
slowly with the vocabulary, which keeps the words that share a reduced word few; it
changes no result.

Nothing but the bitmap is broadcast: joins of tables as long as the vocabulary are
sort-merge joins, whatever size Spark supposes the tables to have.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import lower_ascii, written

LETTERS = "[A-Za-zÀ-ÿ]+"
LEAST_CHARS = 5
LEAST_COUNT = 3
RATIO = 2
FEWEST_SYMBOLS, MOST_SYMBOLS = 4, 16
TYPO_STEP = 97
# Bits of the bitmap of reduced words: a multiple of their number, within limits.
BITS_A_WORD = 16
FEWEST_BITS, MOST_BITS = 12, 27
_CHUNK = 1 << 18  # neighbours made at once, unless one word has more
# Hashes are sums modulo 2^64; an odd base has an inverse there.
_ODD = xxhash.xxh64_intdigest(b"base") | 1
_BASE, _BACK = np.array([[_ODD], [pow(_ODD, -1, 1 << 64)]], dtype=np.uint64)
_SPREAD = np.array([xxhash.xxh64_intdigest(b"letter") | 1], dtype=np.uint64)
_NONE = np.zeros(1, dtype=np.uint64)


def _code(symbol: int) -> int:
    return xxhash.xxh64_intdigest(b"symbol %d" % symbol) | 1


CODES = np.array([_code(s) for s in range(MOST_SYMBOLS)], dtype=np.uint64)


def _merged(left: DataFrame, right: DataFrame, on: Column | str, how: str = "inner") -> DataFrame:
    """A join that broadcasts neither side.

    Spark sizes a written table by its compressed files, and rows that Python makes as if
    they were as many as those it reads; a broadcast chosen by that can fill the driver.
    """
    return left.join(right.hint("merge"), on, how)


def runs(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key`` and ``run`` for every maximal run of letters in the whole texts, only A-Z lower-cased."""
    found = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(LETTERS), F.lit(0))
    return docs.select(F.col(key).alias("key"), F.explode(found).alias("run")).select("key", lower_ascii(F.col("run")).alias("run"))


def misspelt(run: Column, key: Column, step: int = TYPO_STEP) -> Column:
    """``run`` less one code point where ``step`` divides the CRC-32 of ``key:run``; a NULL key is empty."""
    hashed = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run))
    place = (hashed % F.length(run)).cast("int")
    cut = F.concat(run.substr(F.lit(1), place), run.substr(place + 2, F.length(run)))
    return F.when(hashed % step == 0, cut).otherwise(run)


def vocabulary(words: DataFrame, column: str = "word", chars: int = LEAST_CHARS, count: int = LEAST_COUNT) -> DataFrame:
    """``word`` and ``n`` of the words long and frequent enough, counted with map-side combination."""
    long = words.where(F.length(column) >= chars)
    return long.groupBy(F.col(column).alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)


def symbols_for(words: int) -> int:
    """Enough symbols that words of six letters could all have reduced words of their own."""
    return min(MOST_SYMBOLS, max(FEWEST_SYMBOLS, math.ceil(max(words, 1) ** (1 / 6))))


def _by_length(words: list[str], symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length at a time: their places and the symbols of their letters, a row a word.

    A letter's symbol is a hash of its code point, so any alphabet will do.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    letters = ((points * _SPREAD >> np.uint64(32)) % np.uint64(symbols)).astype(np.int64)
    for size in np.unique(sizes):
        places = np.flatnonzero(sizes == size)
        step = max(1, _CHUNK // (2 * symbols * (int(size) + 1)))
        for first in range(0, len(places), step):
            some = places[first : first + step]
            yield some, letters[starts[some][:, None] + np.arange(size)]


def _powers(size: int) -> np.ndarray:
    return np.cumprod(np.concatenate((_NONE + np.uint64(1), np.repeat(_BASE, size))), dtype=np.uint64)


def reduced_hashes(words: list[str], symbols: int) -> np.ndarray:
    out = np.zeros(len(words), dtype=np.uint64)
    for places, own in _by_length(words, symbols):
        out[places] = np.sum(CODES[own] * _powers(own.shape[1])[:-1], axis=1, dtype=np.uint64)
    return out


def neighbourhoods(own: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of reduced words of one length, first, and all their one-edit neighbours, a row a word.

    The mask that follows holds each distinct result once: of a run of one symbol only
    the first is deleted, and no symbol is put before, or in place of, itself.
    """
    words, size = own.shape
    power = _powers(size + 1)
    before = np.zeros((words, size + 1), dtype=np.uint64)
    np.cumsum(CODES[own] * power[:size], axis=1, out=before[:, 1:])
    whole, after = before[:, -1:], before[:, -1:] - before
    deleted = before[:, :-1] + after[:, 1:] * _BACK
    first = np.ones(own.shape, bool)
    first[:, 1:] = own[:, 1:] != own[:, :-1]
    codes = CODES[:symbols]
    inserted = (before + after * _BASE)[:, :, None] + codes * power[: size + 1, None]
    replaced = whole[:, :, None] + (codes - CODES[own][:, :, None]) * power[:size, None]
    fresh = own[:, :, None] != np.arange(symbols)
    hashes = np.hstack((whole, deleted, inserted.reshape(words, -1), replaced.reshape(words, -1)))
    fresh = fresh.reshape(words, -1)
    once = np.ones((words, 1), bool)
    return hashes, np.hstack((once, first, fresh, np.ones((words, symbols), bool), fresh))


def _places(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit of a bitmap of 2^``size`` bits that stand for each hash: its top bits."""
    top = hashes >> np.uint64(64 - size)
    return (top >> np.uint64(6)).astype(np.int64), top & np.uint64(63)


def bitmap(hashed: DataFrame, size: int) -> np.ndarray:
    """The bitmap of all hashes in the column ``own``; its 2^(``size`` - 6) words come to the driver."""
    top = F.shiftrightunsigned("own", 64 - size)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(top, F.lit(64)).cast("int"))
    held = hashed.groupBy(F.shiftright(top, 6).alias("place")).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(1 << (size - 6), dtype=np.uint64)
    out[held["place"].to_numpy(np.int64)] = held["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def neighbours(words: DataFrame, symbols: int, held=None) -> DataFrame:
    """``word``, ``n`` and ``meet``: a row for every hash of the word's neighbourhood.

    With a broadcast bitmap ``held``, neighbours that are no reduced word are left out.
    """
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if held is None else held.value
        size = 0 if bits is None else len(bits).bit_length() + 5
        for batch in batches:
            for places, own in _by_length(batch.column(0).to_pylist(), symbols):
                hashes, wanted = neighbourhoods(own, symbols)
                if bits is not None:
                    place, bit = _places(hashes, size)
                    wanted &= (bits[place] >> bit) & np.uint64(1) > 0
                at = pa.array(places[np.nonzero(wanted)[0]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(hashes[wanted].view(np.int64))],
                    names=["word", "n", "meet"])

    return words.select("word", "n").mapInArrow(made, "word string, n long, meet long")


def near_words(words: DataFrame, symbols: int | None = None) -> DataFrame:
    """``word``, ``n``, ``other``, ``other_n``: all ordered pairs one insertion, deletion or replacement apart.

    ``words`` holds distinct ``word`` with ``n``; NULL words have no pairs.
    """
    chosen = words.where(F.col("word").isNotNull())
    count = chosen.count()
    many = symbols or symbols_for(count)

    @F.pandas_udf("long")
    def own_hash(batch: pd.Series) -> pd.Series:
        return pd.Series(reduced_hashes(batch.to_list(), many).view(np.int64))

    hashed = written(chosen.select("word", "n", own_hash("word").alias("own")), "reduced")
    size = min(MOST_BITS, max(FEWEST_BITS, math.ceil(math.log2(BITS_A_WORD * max(count, 1)))))
    held = words.sparkSession.sparkContext.broadcast(bitmap(hashed, size))  # 2^MOST_BITS bits at most
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mine = neighbours(hashed.repartition(parts), many, held)
    theirs = hashed.select(F.col("own").alias("meet"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return _merged(mine, theirs, "meet").where(
        (F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1)).drop("meet")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of every row of ``word`` and ``n``.

    ``form`` is the near word of largest ``n`` (ties: the first in code-point order)
    if that ``n`` is at least ``ratio`` (2 or more) times the word's, else NULL;
    ``root`` the last word reached by forms, the word itself if it has none.  An
    empty table gives an empty table.
    """
    stored = written(words.select("word", "n"), "vocabulary")
    best = written(
        near_words(stored).groupBy("word").agg(
            F.count(F.lit(1)).alias("n_near"),
            F.min(F.struct((-F.col("other_n")).alias("down"), F.col("other").alias("form"))).alias("best")), "near")
    chosen = best.select(
        F.col("word").alias("_word"), "n_near", F.col("best.form").alias("_form"), (-F.col("best.down")).alias("_form_n"))
    tied = _merged(stored, chosen, stored["word"] == chosen["_word"], "left").drop("_word")
    follows = F.col("_form_n") >= ratio * F.col("n")
    named = written(tied.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(follows, F.col("_form")).alias("form"), F.when(follows, F.col("_form_n")).alias("form_n")), "forms")
    roots = _roots(named.where(F.col("form").isNotNull()).select("word", "form"), _steps(named, ratio))
    out = _merged(named, roots, named["word"] == roots["_from"], "left")
    return out.select("word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")


def _steps(named: DataFrame, ratio: int) -> int:
    """The most forms that can follow each other: counts grow by ``ratio`` at each."""
    most = named.agg(F.max("n")).first()[0] or 1
    return max(1, math.floor(math.log(max(most, 1), ratio)) + 1)


def _roots(links: DataFrame, steps: int) -> DataFrame:
    """``_from``, ``_root``: ends of chains of at most ``steps`` links, each round doubling their length."""
    current = links.select(F.col("word").alias("_from"), F.col("form").alias("_root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        current = written(current, "roots")
        ahead = current.select(F.col("_from").alias("_at"), F.col("_root").alias("_next"))
        current = _merged(current, ahead, current["_root"] == ahead["_at"], "left").select(
            "_from", F.coalesce("_next", "_root").alias("_root"))
    return current
