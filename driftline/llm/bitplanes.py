"""Token ids as byte planes in blocks of fixed size.

Documents are range-partitioned and sorted by key; each partition becomes one
shard, a stream of unsigned 32-bit ids cut into blocks of ``BLOCK_IDS``.  A block
is transposed into its four byte planes and each plane is compressed with
zstandard alone; a plane of zeros takes no bytes.

The blocks are rows of a table that Spark itself writes and commits, so a lost
executor repeats its own shard and never leaves half of one.  Its columns are the
chunk index (``shard``, ``block``, ``first``, ``n_ids`` and the pieces of
documents in the block), which can be read without the planes, and ``planes``.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from driftline.llm.tokens import BYTE_LETTERS, CHUNK_ENTRIES, PIECE_ENTRIES, Kept, PieceEncoder, pre_tokens

BLOCK_IDS = 65_536
PLANES = 4
LEVEL = 3
END_ID = 2
CRC_POLYNOMIAL = 0xEDB88320

PIECES = ["doc_key", "doc_start", "doc_ids", "piece_start", "piece_ids"]
BLOCK_SCHEMA = (
    "shard int, block int, first long, n_ids int, doc_key array<long>, doc_start array<long>, "
    "doc_ids array<long>, piece_start array<int>, piece_ids array<int>, planes array<binary>"
)
_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_BLOCK_ARROW = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()),
    ("doc_key", _LONGS), ("doc_start", _LONGS), ("doc_ids", _LONGS), ("piece_start", _INTS), ("piece_ids", _INTS),
    ("planes", pa.list_(pa.binary())),
])


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    values = array("I", ids)
    if sys.byteorder == "big":
        values.byteswap()
    return values.tobytes()


def to_planes(data: bytes | memoryview, compressor: zstandard.ZstdCompressor) -> list[bytes]:
    columns = np.frombuffer(data, dtype=np.uint8).reshape(-1, PLANES).T
    return [compressor.compress(p.tobytes()) if p.any() else b"" for p in columns]


def from_planes(planes: list[bytes], n_ids: int, decompressor: zstandard.ZstdDecompressor) -> bytes:
    columns = np.zeros((n_ids, PLANES), dtype=np.uint8)
    for i, plane in enumerate(planes):
        if plane:
            columns[:, i] = np.frombuffer(decompressor.decompress(plane, max_output_size=n_ids), dtype=np.uint8)
    return columns.tobytes()


class BatchEncoder:
    """Packed ids of whole texts, a batch at a time.

    Ordinary texts are cut into pre-tokens together; each distinct one of a batch
    is looked up once, in a bounded cache or the library, and Arrow puts the ids in
    the order of the texts.  Any other text is encoded by itself.
    """

    def __init__(self, tokenizer: str):
        self.one = PieceEncoder(tokenizer, packed, b"".join)
        self.one.spaced.limit = PIECE_ENTRIES  # few texts get there
        self.known = Kept(self._ids, CHUNK_ENTRIES)

    def _ids(self, piece: bytes) -> bytes:
        return packed([t.id for t in self.one.model.tokenize(piece.decode("latin-1").translate(BYTE_LETTERS))])

    def texts(self, batch: pa.Array) -> list[bytes]:
        rows = batch.to_pylist()
        plain = [self.one.plain(text) for text in rows]
        pieces, places = pre_tokens(batch.filter(pa.array(plain, pa.bool_())))
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        stream = pa.array([self.known[p] for p in distinct], pa.large_binary()).take(coded.indices)
        data = memoryview(stream.buffers()[2] or b"")
        ends = np.frombuffer(stream.buffers()[1], np.int64)[places].tolist() if len(stream) else []
        made = (bytes(data[a:b]) for a, b in pairwise(ends))
        return [next(made) if is_plain else self.one.text(text) for text, is_plain in zip(rows, plain, strict=True)]


@lru_cache(maxsize=1)
def _worker_encoder(tokenizer: str) -> BatchEncoder:
    """One encoder for all tasks of a worker, so its caches stay warm."""
    return BatchEncoder(tokenizer)


class _Shard:
    """The id stream of one partition, cut into blocks as it grows."""

    def __init__(self, number: int, block_ids: int):
        self.number, self.block_ids = number, block_ids
        self.block, self.first, self.total = 0, 0, 0
        self.buffer, self.docs = bytearray(), []
        self.compressor = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, key, ids: bytes) -> None:
        n = len(ids) // 4
        self.docs.append((key, self.total, n))
        self.total += n
        self.buffer += ids

    def blocks(self, last: bool = False) -> Iterator[dict]:
        while len(self.buffer) >= 4 * self.block_ids or last and self.buffer:
            n = min(self.block_ids, len(self.buffer) // 4)
            until = self.first + n
            inside = [d for d in self.docs if d[1] < until]
            begins = [max(start, self.first) for _, start, _ in inside]
            ends = [min(start + size, until) for _, start, size in inside]
            yield {
                "shard": self.number, "block": self.block, "first": self.first, "n_ids": n,
                "doc_key": [d[0] for d in inside], "doc_start": [d[1] for d in inside],
                "doc_ids": [d[2] for d in inside],
                "piece_start": [b - self.first for b in begins],
                "piece_ids": [e - b for b, e in zip(begins, ends, strict=True)],
                "planes": to_planes(memoryview(self.buffer)[: 4 * n].tobytes(), self.compressor),
            }
            del self.buffer[: 4 * n]
            self.docs = [d for d in self.docs if d[1] + d[2] > until]
            self.block, self.first = self.block + 1, until


def write_ids(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, key: str = "doc_id", text_col: str = "text",
    shards: int | None = None, block_ids: int = BLOCK_IDS,
) -> None:
    """Encode every text, append ``end_id`` to each and write the blocks to ``path``.

    Shards follow ascending keys (NULL first; equal keys by a hash of the text).
    NULL and empty texts hold the end id alone.  Repeated rows are written as
    often as they come.  An empty table writes an empty table.
    """
    spark = docs.sparkSession
    parts = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("_key").asc_nulls_first(), F.col("_tie")]
    ordered = (
        docs.select(F.col(key).cast("long").alias("_key"), F.xxhash64(text_col).alias("_tie"),
                    F.col(text_col).alias("_text"))
        .repartitionByRange(parts, *order).sortWithinPartitions(*order).select("_key", "_text")
    )
    end = packed([end_id])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(tokenizer)
        shard = _Shard(TaskContext.get().partitionId(), block_ids)
        for batch in batches:
            for doc_key, ids in zip(batch.column(0).to_pylist(), encoder.texts(batch.column(1)), strict=True):
                shard.add(doc_key, ids + end)
            if made := list(shard.blocks()):
                yield pa.RecordBatch.from_pylist(made, schema=_BLOCK_ARROW)
        if made := list(shard.blocks(last=True)):
            yield pa.RecordBatch.from_pylist(made, schema=_BLOCK_ARROW)

    ordered.mapInArrow(encode, BLOCK_SCHEMA).write.option("compression", "none").parquet(path)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def read_pieces(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document and block it has ids in: its key, its place, ``crc`` and ``ids``.

    ``ids`` are the ids themselves as little-endian 32-bit integers, NULL unless
    ``with_ids``; ``crc`` is the CRC-32 of those bytes.
    """
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                data = from_planes(row["planes"], row["n_ids"], decompressor)
                parts = [data[4 * s : 4 * (s + n)] for s, n in zip(row["piece_start"], row["piece_ids"], strict=True)]
                n = len(parts)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["shard"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()),
                    *[pa.array(row[c], pa.int64()) for c in PIECES[:3]],
                    pa.array(row["piece_ids"], pa.int32()),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                    pa.array(parts if with_ids else [None] * n, pa.binary()),
                ], names=["shard", "block", *PIECES[:3], "n", "crc", "ids"])

    return blocks(spark, path).mapInArrow(
        decode, "shard int, block int, doc_key long, doc_start long, doc_ids long, n int, crc long, ids binary")


def _product(a: int, b: int) -> int:
    """Product of two polynomials over GF(2), bit-reversed, modulo the CRC's."""
    out = 0
    for place in range(31, -1, -1):
        if a >> place & 1:
            out ^= b
        b = (b >> 1) ^ (CRC_POLYNOMIAL if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two byte strings put together, from the CRC of each."""
    power, base, times = 1 << 31, 1 << 30, 8 * second_bytes
    while times:
        if times & 1:
            power = _product(power, base)
        base, times = _product(base, base), times >> 1
    return _product(power, first) ^ second


@F.pandas_udf(LongType())
def _whole_crc(pieces: pd.Series) -> pd.Series:
    def one(parts) -> int:
        if parts is None:  # a document of one piece, whose CRC is known
            return 0
        crc = int(parts[0]["crc"])
        for part in parts[1:]:
            crc = joined_crc(crc, int(part["crc"]), 4 * int(part["n"]))
        return crc

    return pieces.map(one).astype("int64")


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_key``, ``start``, ``n_tokens``, ``ids_crc32`` of every document, read from the files.

    ``start`` counts the ids of all documents before it.  Only piece rows are
    shuffled, never ids; what crosses shards is one total a shard.
    """
    totals = blocks(spark, path).groupBy("shard").agg(F.sum("n_ids").alias("_ids"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("shard", F.coalesce(F.sum("_ids").over(earlier), F.lit(0)).alias("_before"))
    pieces = F.struct("block", "n", "crc")
    several = F.size("_pieces") > 1
    joined = _whole_crc(F.when(several, F.col("_pieces")))
    return (
        read_pieces(spark, path, with_ids=False)
        .groupBy("shard", "doc_start", "doc_key", "doc_ids")
        .agg(F.sort_array(F.collect_list(pieces)).alias("_pieces"))
        .join(before, "shard")
        .select(
            "doc_key", (F.col("_before") + F.col("doc_start")).alias("start"),
            F.col("doc_ids").alias("n_tokens"),
            F.when(several, joined).otherwise(F.col("_pieces")[0]["crc"]).alias("ids_crc32"),
        )
    )
