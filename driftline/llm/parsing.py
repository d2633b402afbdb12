"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed bottom up.  On each level neighbouring symbols are
coloured by deterministic coin tossing: a symbol takes twice the place of the
lowest bit in which it differs from its left neighbour, plus that bit; after a
few rounds colours are small, and symbols whose colour is a local maximum begin
phrases.  A run of one symbol is a phrase of its own.  Phrases are named by a hash
of their symbols and are the symbols of the next level.  Where a phrase begins
depends on a few symbols around it alone, so equal substrings get equal phrases
inside, wherever they stand.

The fingerprint samples the names of levels ``FIRST_LEVEL`` and up in
``BINS`` bins by their hashes, the least name in each; likeness is the share of
bins that agree.  Texts are handled many at a time as one array, whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from driftline.llm.common import text_bytes, written
from driftline.llm.ranges import LOWEST, sampled_splitters

FIRST_LEVEL = 3  # phrases of about twenty bytes
LEVELS = 5
BINS = 64
ROUNDS = 4  # 64-bit names: places below 128, then 14, then 8, then 6
_EMPTY = np.uint16(0)
SLAB_BYTES = 4 << 20
RANGES_PER_PARTITION = 8

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_LAST = np.uint64(0x94D049BB133111EB)


def mixed(values: np.ndarray) -> np.ndarray:
    """A fixed 64-bit scrambling of unsigned integers."""
    v = values + _ODD
    v = (v ^ (v >> np.uint64(30))) * _MIX
    v = (v ^ (v >> np.uint64(27))) * _LAST
    return v ^ (v >> np.uint64(31))


def _lowest_difference(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Twice the place of the lowest differing bit, plus that bit of the symbol."""
    differ = symbols ^ left
    lowest = differ & (~differ + np.uint64(1))
    place = np.bitwise_count(lowest - np.uint64(1))
    return 2 * place.astype(np.uint64) + ((symbols & lowest) != 0)


def _begins(symbols: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Where phrases begin: at each text, at runs of one symbol, and at local maxima of colour."""
    n = len(symbols)
    new_text = np.ones(n, bool)
    new_text[1:] = owner[1:] != owner[:-1]
    same = np.zeros(n, bool)  # equal to its left neighbour
    same[1:] = (symbols[1:] == symbols[:-1]) & ~new_text[1:]
    run = same.copy()
    run[:-1] |= same[1:]
    # Colours are compared inside stretches without runs only.
    edge = new_text | run
    edge[1:] |= run[:-1]
    colour = symbols
    for _ in range(ROUNDS):
        left = np.empty_like(colour)
        left[0], left[1:] = 0, colour[:-1]
        left[edge] = ~colour[edge]  # a stretch begins with colour 0 or 1
        colour = _lowest_difference(colour, left)
    ends = np.ones(n, bool)
    ends[:-1] = edge[1:]
    peak = np.zeros(n, bool)
    if n > 2:
        middle = colour[1:-1]
        peak[1:-1] = (middle > colour[:-2]) & (middle >= colour[2:])
    peak &= ~edge & ~ends
    begins = new_text | peak
    begins |= run & ~same
    begins[1:] |= run[:-1] & ~run[1:]
    return begins


def _names(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each phrase's symbols in order; runs of any length are summed the same way."""
    place = np.arange(len(symbols)) - np.repeat(starts, np.diff(np.append(starts, len(symbols))))
    return mixed(np.add.reduceat(mixed(symbols + mixed(place.astype(np.uint64))), starts))


def sketches(texts: list[bytes]) -> np.ndarray:
    """One row of ``BINS`` 16-bit marks for every text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    least = np.full((len(texts), BINS), np.iinfo(np.uint64).max, dtype=np.uint64)
    symbols = mixed(np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint64))
    owner = np.repeat(np.arange(len(texts)), sizes)
    for level in range(1, FIRST_LEVEL + LEVELS):
        if not len(symbols):
            break
        starts = np.flatnonzero(_begins(symbols, owner))
        symbols, owner = _names(symbols, starts), owner[starts]
        if level >= FIRST_LEVEL:  # a text too short for it still has one name here
            seen = mixed(symbols ^ np.uint64(level))
            np.minimum.at(least, (owner, (seen >> np.uint64(58)).astype(np.int64)), seen)
            alone = np.bincount(owner, minlength=len(texts)) > 1
            keep = alone[owner]
            symbols, owner = symbols[keep], owner[keep]
    marks = ((least >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.uint16) | np.uint16(1)
    marks[least == np.iinfo(np.uint64).max] = _EMPTY
    return marks


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """Share of the bins filled in either sketch whose marks agree; 1 for two empty texts."""
    filled = (one != _EMPTY) | (other != _EMPTY)
    return float((one == other)[filled].mean()) if filled.any() else 1.0


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many from the start of the next text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


@F.pandas_udf(StringType())
def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The fingerprint of whole texts as hex digits; NULL counts as empty."""
    for texts in batches:
        yield pd.Series([s.tobytes().hex() for s in _all_sketches([t or "" for t in texts])], dtype=object)


def _all_sketches(texts: list[str]) -> list[np.ndarray]:
    """Sketches of any number of texts, about ``SLAB_BYTES`` at a time."""
    out, slab, held = [], [], 0
    for text in texts:
        data = text.encode("utf-8")
        slab.append(data)
        held += len(data)
        if held >= SLAB_BYTES:
            out += list(sketches(slab))
            slab, held = [], 0
    return out + (list(sketches(slab)) if slab else [])


COMPARED = (
    "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come range by range in descending order; a range ends with a borrowed row."""
    waiting = None
    for batch in batches:
        if waiting is not None:
            batch = pd.concat([waiting, batch], ignore_index=True)
        waiting = batch.iloc[[-1]]
        if len(batch) > 1:
            yield _compared(batch)
    if waiting is not None and not waiting["_borrowed"].iloc[0]:
        raise ValueError("a range must end with the row after it")


def _compared(batch: pd.DataFrame) -> pd.DataFrame:
    texts = [t or "" for t in batch["_text"]]
    own = np.flatnonzero(~batch["_borrowed"].to_numpy(bool)[:-1])
    marks = _all_sketches(texts)
    changed = [edited(texts[i], texts[i + 1]) for i in own]
    other = _all_sketches(changed)
    return pd.DataFrame({
        "key": batch["_key"].iloc[own].astype("Int64").array,
        "n_chars": [len(texts[i]) for i in own],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in changed],
        "fingerprint": [marks[i].tobytes().hex() for i in own],
        "edited_fingerprint": [m.tobytes().hex() for m in other],
        "near_edited": [likeness(marks[i], m) for i, m in zip(own, other, strict=True)],
        "near_next": [likeness(marks[i], marks[i + 1]) for i in own],
    })


def compare_with_next(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and how near it is to both.

    Documents stand in descending order of key (NULL last, equal keys by a hash of
    the text); the document after the last is the first.  NULL texts are empty.
    Texts are shuffled once, into ranges cut by sampled splitters; the first
    row of a range is lent to the range before it.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    one = F.coalesce(F.bitwise_not(F.col(key).cast("long")), F.lit((1 << 63) - 1))
    two = F.xxhash64(F.coalesce(text, F.lit("")))
    keys = written(docs.select(one.alias("one"), two.alias("two"), (text_bytes(text) + 1).alias("size")), "keys")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    splitters, parts = sampled_splitters(keys, partitions * RANGES_PER_PARTITION)
    rows = docs.select(F.col(key).cast("long").alias("_key"), text.alias("_text"), one.alias("_one"), two.alias("_two"))
    place = splitters.range_of(F.col("_one"), F.col("_two"))
    return _ranged(rows.withColumn("_part", place), keys, splitters, [p.part for p in parts], partitions)


def _ranged(rows: DataFrame, keys: DataFrame, splitters, parts: list[int], partitions: int) -> DataFrame:
    spark = rows.sparkSession
    heads = keys.groupBy(splitters.range_of(F.col("one"), F.col("two")).alias("part")).agg(
        F.min(F.struct("one", "two")).alias("head"))
    before = {part: parts[i - 1] for i, part in enumerate(parts)}
    lent = [(h.part, h["head"]["one"], h["head"]["two"], before[h.part]) for h in heads.collect()]  # one row a range
    lending = F.broadcast(spark.createDataFrame(lent, "_part int, _one long, _two long, _to int"))
    first = rows.join(lending, ["_part", "_one", "_two"]).dropDuplicates(["_to"])
    both = rows.select("_part", F.lit(False).alias("_borrowed"), "_one", "_two", "_key", "_text").union(
        first.select("_to", F.lit(True), "_one", "_two", "_key", "_text"))
    return (
        both.repartition(partitions, "_part").sortWithinPartitions("_part", "_borrowed", "_one", "_two")
        .select("_borrowed", "_key", "_text").mapInPandas(_compare, COMPARED)
    )
