"""Token counts by a two-tier lookup, without a shuffle of pre-tokens.

Tier one is a broadcast hash table with the lengths of frequent pre-tokens,
gathered from a bounded sample of rows (``TABLE_ENTRIES`` entries of a few
bytes; it only saves work, counts do not depend on it).  Tier two is a cache in
each Python worker: what neither tier knows is encoded once by the library and
kept.  Both tiers are bounded, so a worker's memory does not grow with the input.

Texts are cut where the library itself would cut them.  A text of ordinary
Latin letters, digits and punctuation whose spaces stand alone falls apart at
its spaces; any other text goes through the library's own pre-tokenizer.  A
tokenizer whose file asks for more than byte-level pre-tokens (a normalizer,
prefix spaces, another pre-tokenizer) encodes whole texts.  ``pre_tokens`` cuts
a whole batch of ordinary texts at once, whatever their spaces.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import text_bytes

TABLE_ENTRIES = 32_768
SAMPLE_ROWS = 20_000
CHUNK_ENTRIES = 500_000
PIECE_ENTRIES = 100_000

# The byte-level split rule, in terms of Python's classes; equal to the
# library's on the characters of PLAIN, the only ones it is used for.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
NOT_PLAIN = re.compile("[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ɏ–—‘’“”…«»¡¿€]")
STOPS = (".", ",", ";", ":", "!", "?")
SPACE_PAIRS = ("  ", " \n", " \t", " \r")
CONTRACTION = re.compile(rb"'(?:s|t|re|ve|m|ll|d)")
MARK, LETTER, DIGIT, SPACE = range(4)


def _kind(byte: int) -> int:
    """What the first byte of a character of PLAIN begins."""
    if byte >= 0x80:
        return LETTER if 0xC3 <= byte <= 0xC9 else MARK
    char = chr(byte)
    return LETTER if char.isalpha() else DIGIT if char.isdigit() else SPACE if char.isspace() else MARK


KINDS = bytes(map(_kind, range(256)))


def pre_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The pre-tokens of texts of PLAIN characters, text after text, as UTF-8 bytes; where each text's begin.

    The places have one more entry, the number of all pre-tokens.  The rule is
    PIECE's, applied to the bytes of all texts at once; none may be NULL.
    """
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, n = bounds[0], int(bounds[-1] - bounds[0])
    raw = texts.buffers()[2][first : first + n].to_pybytes() if n else b""
    byte, kind = np.frombuffer(raw, np.uint8), np.frombuffer(bytearray(raw).translate(KINDS), np.uint8)
    if not raw.isascii():
        inner = np.flatnonzero((byte & 0xC0) == 0x80)
        for _ in range(2):  # characters of PLAIN have three bytes at most
            kind[inner] = kind[inner - 1]
    begins = np.zeros(n + 1, bool)
    begins[bounds - first] = True
    cut = begins.copy()
    cut[1:n] |= kind[1:] != kind[:-1]
    # The last of the white space before a word stands alone or, if a space, begins the word.
    space = kind == SPACE
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~begins[1:n])
    cut[last] = True
    cut[last + 1] = byte[last] != 0x20
    if short := [m.span() for m in CONTRACTION.finditer(raw)]:
        at, end = np.array(short).T
        whole = cut[at] & ~begins[at + 1] & ~begins[end - 1]
        cut[at[whole] + 1] = False
        cut[end[whole]] = True
    cuts = np.flatnonzero(cut)
    pieces = pa.Array.from_buffers(
        pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64, copy=False)), pa.py_buffer(raw)])
    return pieces, np.searchsorted(cuts, bounds - first)


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in printable}
    hidden = (b for b in range(256) if b not in letters)
    return letters | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()
SPACE_LETTER = BYTE_LETTERS[0x20]  # ASCII letters stand for themselves


class Kept(dict):
    """A bounded cache that computes what it does not hold.

    It has two generations: when the young one (the dictionary itself) is full it
    becomes the old one, and what is still asked for comes back from there.
    """

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class PieceEncoder:
    """Maps whole texts to something additive over pre-tokens: lengths or packed ids.

    ``measure`` turns a list of ids into a value and ``join`` adds an iterable of
    such values up, so that the value of a text is the join over its pieces.
    """

    def __init__(self, path: str, measure: Callable, join: Callable, frequent: dict | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.measure, self.join = measure, join
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        pre, added = config.get("pre_tokenizer") or {}, config.get("added_tokens") or []
        self.by_piece = (
            config.get("normalizer") is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space", True)
            and config["model"]["type"] == "BPE"
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added)
        )
        self.special = {t["content"]: t["id"] for t in added}
        self.marks = re.compile("(%s)" % "|".join(
            re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if added else None
        self.frequent, self.model = frequent or {}, self.tokenizer.model
        self.pieces = Kept(self._piece, PIECE_ENTRIES)
        self.spaced = Kept(self._after_space, CHUNK_ENTRIES)
        self.mapped = Kept(self._mapped, PIECE_ENTRIES)

    def _mapped(self, letters: str):
        return self.measure([t.id for t in self.model.tokenize(letters)])

    def _piece(self, piece: str):
        known = self.frequent.get(piece)
        if known is not None:
            return known
        return self._mapped(piece.encode("utf-8").decode("latin-1").translate(BYTE_LETTERS))

    def _chunk(self, chunk: str):
        return self.join(map(self.pieces.__getitem__, PIECE.findall(chunk)))

    def _after_space(self, word: str):
        """What a space and a stretch without spaces come to; plain words need no pattern."""
        if word.isalpha():
            if not word.isascii():
                return self._piece(" " + word)
            known = self.frequent.get(" " + word) if self.frequent else None
            return self._mapped(SPACE_LETTER + word) if known is None else known
        if word[-1:] in STOPS and word[:-1].isalpha():
            return self.join((self.spaced[word[:-1]], self.pieces[word[-1]]))
        return self._chunk(" " + word)

    def _span(self, text: str):
        """The value of a text without special strings."""
        if NOT_PLAIN.search(text):
            split = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
            return self.join(map(self.mapped.__getitem__, [letters for letters, _ in split]))
        if text.endswith(" ") or any(pair in text for pair in SPACE_PAIRS):
            return self._chunk(text)
        first, *rest = text.split(" ")
        parts = map(self.spaced.__getitem__, rest)
        return self.join((self._chunk(first), *parts)) if first else self.join(parts)

    def plain(self, text: str | None) -> bool:
        """Whether ``pre_tokens`` may cut the text: no special strings, only characters of PLAIN."""
        return (self.by_piece and bool(text) and not NOT_PLAIN.search(text)
                and (self.marks is None or not self.marks.search(text)))

    def text(self, text: str | None):
        if not text:
            return self.join(())
        if not self.by_piece:
            return self.measure(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if self.marks is None or not self.marks.search(text):
            return self._span(text)
        parts = []
        for i, part in enumerate(self.marks.split(text)):
            if i % 2:
                parts.append(self.measure([self.special[part]]))
            elif part:
                parts.append(self._span(part))
        return self.join(parts)


# Encoders live as long as their worker; the newest table wins.
_ENCODERS: dict[str, tuple[dict, PieceEncoder]] = {}


def _length_encoder(path: str, frequent: dict) -> PieceEncoder:
    known = _ENCODERS.get(path)
    if known is None or known[0] is not frequent:
        _ENCODERS[path] = known = (frequent, PieceEncoder(path, len, sum, frequent))
    return known[1]


class SentencePieceCounter:
    """Counts ids of a sentencepiece model, whole text by whole text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def text(self, text: str | None) -> int:
        return len(self.model.encode(text, add_bos=False, add_eos=False)) if text else 0


@lru_cache(maxsize=4)
def _piece_model(path: str) -> SentencePieceCounter:
    return SentencePieceCounter(path)


def frequent_lengths(docs: DataFrame, path: str, text_col: str = "text") -> dict[str, int]:
    """Lengths of the commonest pre-tokens in a sample of at most about ``SAMPLE_ROWS`` rows."""
    rows = docs.count()
    sample = docs.select(F.col(text_col).alias("text")).sample(min(1.0, SAMPLE_ROWS / max(rows, 1)), seed=7)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = Counter()
            for text in batch["text"].dropna():
                if not NOT_PLAIN.search(text):
                    counts.update(PIECE.findall(text))
            top = counts.most_common(TABLE_ENTRIES)
            yield pd.DataFrame({
                "piece": pd.Series([p for p, _ in top], dtype=object),
                "n": pd.Series([n for _, n in top], dtype="int64"),
            })

    top = (
        sample.mapInPandas(pieces, "piece string, n long")
        .groupBy("piece").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "piece").limit(TABLE_ENTRIES)
    )
    encoder = PieceEncoder(path, len, sum)
    return {row.piece: encoder._piece(row.piece) for row in top.collect()} if encoder.by_piece else {}


def token_counts(
    docs: DataFrame, path: str, limit: int = 512, text_col: str = "text",
    frequent: dict[str, int] | None = None,
) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` to every row.

    ``path`` is a tokenizers file (``.json``) or a sentencepiece model
    (``.model``).  No begin, end or padding ids are counted; special strings in a
    text count as the library's default has them.  NULL and empty texts have 0
    bytes and 0 tokens.  Columns already named like an output are replaced, all
    others, repeated rows included, stay as they are.
    """
    if path.endswith(".model"):
        @F.pandas_udf("long")
        def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([_piece_model(path).text(t) for t in texts], dtype="int64")
    else:
        table = frequent_lengths(docs, path, text_col) if frequent is None else frequent
        shared = docs.sparkSession.sparkContext.broadcast(table)

        @F.pandas_udf("long")
        def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            encoder = _length_encoder(path, shared.value)
            for texts in batches:
                yield pd.Series([encoder.text(t) for t in texts], dtype="int64")

    text = F.col(text_col)
    return docs.withColumns({"n_bytes": text_bytes(text), "n_tokens": counted(text)}).withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
