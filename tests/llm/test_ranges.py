from collections import defaultdict
from zlib import crc32

from pyspark.sql import functions as F

from driftline.llm import ranges
from driftline.llm.queries import QUERIES


def gapless(rows, shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards))


def filled(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.shard] += r.size
    return sizes


def test_query(session, data):
    docs = {r.doc_id: r.text for r in session.read.parquet(f"{data}/documents.parquet").collect()}
    rows = QUERIES["op7_sampled_splitters"](session, data).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.size == len(docs[r.doc_id].encode()) + 1 and r.text_crc32 == crc32(docs[r.doc_id].encode()) for r in rows)
    gapless(rows, 8)
    sizes, largest = filled(rows), max(r.size for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest
    of_text = defaultdict(set)
    for r in rows:
        of_text[docs[r.doc_id]].add(r.shard)
    assert sum(len(s) > 1 for s in of_text.values()) <= 1


def test_hot_group_is_subdivided(session):
    docs = session.range(6000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("copy " * 20)).when(F.col("id") % 3 == 1, F.lit(""))
        .otherwise(F.repeat(F.col("id").cast("string"), (F.col("id") % 50).cast("int"))).alias("text"))
    rows = ranges.shard_keys(docs, 8).collect()
    assert len(rows) == 6000
    gapless(rows, 8)
    sizes = filled(rows)
    assert max(sizes.values()) < 1.05 * min(sizes.values())
    splitters, parts = ranges.sampled_splitters(
        docs.select(*[c.alias(n) for n, c in ranges.key_columns(F.col("text"), F.col("doc_id")).items()]), 64)
    assert max(p.mass for p in parts) <= 2 / 64 and sum(p.rows for p in parts) == 6000


def test_odd_rows_and_clashing_names(session, odd_docs):
    docs = odd_docs.withColumns({"shard": F.lit("old"), "one": F.lit(1), "_part": F.lit(2)})
    sharded = ranges.shard_documents(docs.union(docs), 3)
    assert sharded.columns == [*[c for c in docs.columns if c != "shard"], "shard", "slot"]
    rows = sharded.collect()
    assert len(rows) == 2 * docs.count()
    gapless(rows, 3)


def test_one_row_many_equal_rows_and_none(session, odd_docs):
    same = session.createDataFrame([(1, "x")] * 50, "doc_id long, text string")
    rows = ranges.shard_keys(same, 4).collect()
    assert len(rows) == 50
    gapless(rows, 4)
    assert ranges.shard_keys(same.limit(1), 4).count() == 1
    assert ranges.shard_keys(same.limit(0), 4).collect() == []
    assert ranges.shard_documents(odd_docs.limit(0), 4).collect() == []
