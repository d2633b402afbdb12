from collections import defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from driftline.llm import balancing
from driftline.llm.queries import QUERIES


def checked(rows, few=False):
    """Rows of (source, size, target, copies): targets as wanted, sources near them, no copy above the cap.

    A source of few documents may miss its target by half of its largest.
    """
    sizes, taken, target, smallest, largest = defaultdict(int), defaultdict(int), {}, {}, {}
    for source, size, goal, copies in rows:
        sizes[source] += size
        taken[source] += copies * size
        target[source] = goal
        smallest[source] = min(smallest.get(source, size or 1 << 60), size or 1 << 60)
        largest[source] = max(largest.get(source, 0), size)
        assert 0 <= copies <= 2
    wanted = brute.targets(dict(sizes))
    for s in sizes:
        assert abs(target[s] - wanted[s]) <= 1e-6 * max(1, wanted[s])
        near = largest[s] / 2 if few else max(smallest[s], 1e-6 * wanted[s])
        assert abs(taken[s] - wanted[s]) <= near if sizes[s] else taken[s] == 0
    return dict(taken)


def test_query(session, data):
    docs = {r.doc_id: r for r in session.read.parquet(f"{data}/documents.parquet").collect()}
    rows = QUERIES["op10_entropy_balancing"](session, data).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r["size"] == len(brute.spaced(docs[r.doc_id].text)) for r in rows)
    checked([(docs[r.doc_id].source, r["size"], r.target, r.taken // max(r["size"], 1)) for r in rows], few=True)
    assert brute.count_rows(rows) == brute.count_rows(QUERIES["op10_entropy_balancing"](session, data).collect())


def mixed_rows(docs):
    return [(r.source, r["size"], r["target"], r["copies"]) for r in balancing.with_copies(docs).collect()]


def test_hot_source_of_equal_documents_and_a_null_source(session):
    docs = session.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 2 == 0, "b").when(F.col("id") % 10 == 1, None)
        .otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"),
        F.when(F.col("id") % 2 == 0, F.lit("five words in this text"))
        .otherwise(F.repeat(F.lit("w "), (F.col("id") % 83).cast("int"))).alias("text"))
    rows = mixed_rows(docs)
    assert len(rows) == 3000
    checked(rows)


def test_odd_rows(session, odd_docs):
    rows = mixed_rows(odd_docs)
    assert len(rows) == odd_docs.count()
    mixed = balancing.mixed(odd_docs)
    assert mixed.columns == odd_docs.columns
    kept = brute.count_rows(mixed.collect())
    assert sum(kept.values()) == sum(copies for *_, copies in rows)
    assert kept.keys() <= brute.count_rows(odd_docs.collect()).keys()


def test_no_words_and_no_rows(session, odd_docs):
    blank = session.createDataFrame([(1, "a", ""), (2, "a", None), (3, None, " ")], "doc_id long, source string, text string")
    assert [copies for *_, copies in mixed_rows(blank)] == [1, 1, 1]
    assert balancing.mixed(odd_docs.limit(0)).collect() == []


def targets(session, sizes, weights, share=1.5, cap=2):
    rows = session.createDataFrame(list(enumerate(sizes)), "_place long, size long")
    return [r.target for r in balancing.with_targets(rows, weights, share, cap).orderBy("_place").collect()]


def test_targets(session):
    assert targets(session, [10, 10, 100], (3, 1, 2)) == [20, 20, 140]
    assert targets(session, [], (3, 1, 2)) == []
    assert targets(session, [0, 4], (3, 1)) == [0, 6]
    assert targets(session, [5, 7], (1, 1), share=2) == [10, 14]
    assert targets(session, [1, 2, 4, 8, 16, 1000], (1,)) == [2, 4, 8, 16, 32, pytest.approx(1484.5)]


def test_many_sources(session):
    """As many sources as documents: nothing about them is gathered."""
    docs = session.range(6000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 2500).alias("source"),
        F.repeat(F.lit("w "), (1 + F.col("id") * 7919 % 40).cast("int")).alias("text"))
    rows = mixed_rows(docs)
    assert len(rows) == 6000
    checked(rows, few=True)
