import random

import pytest
from pyspark.sql import functions as F

from driftline.llm import simhash
from driftline.llm.components import smallest_reachable
from driftline.llm.queries import QUERIES
import brute


def signed(value):
    return value - (1 << 64) if value >> 63 else value


@pytest.fixture(scope="module")
def prints():
    """Fingerprints with chains, dense balls and edge values, and their keys."""
    draw = random.Random(3)
    values = [0, (1 << 64) - 1, 1, 3, 1 << 63]
    for _ in range(40):
        at = draw.getrandbits(64)
        for _ in range(draw.randrange(1, 12)):
            values.append(at)
            for _ in range(draw.randrange(1, 4)):
                at ^= 1 << draw.randrange(64)
    center = draw.getrandbits(64)
    values += [center ^ (1 << a) ^ (1 << b) for a in range(0, 64, 5) for b in range(a)]
    rows = [(i * 7 % 1009, v) for i, v in enumerate(values)]
    return [*rows, (None, values[5]), rows[7], (2000, values[9])]


def test_links_and_components_equal_brute_force(session, prints):
    table = session.createDataFrame([(k, signed(v)) for k, v in prints], "doc_id long, fingerprint long")
    values = sorted({signed(v) for _, v in prints})
    wanted = {(a, b) for a in values for b in values if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    assert {(r.u, r.v) for r in simhash.links(simhash.pivot_table(table)).collect()} == wanted
    got = brute.count_rows(simhash.with_components(table).select("doc_id", "fingerprint", "component_id").collect())
    named = brute.components(prints)
    assert got == brute.count_rows((k, signed(v), c) for (k, v), c in zip(prints, named, strict=True))


def test_query_equals_brute_force(session, data):
    texts = [(r.doc_id, brute.fingerprint(r.text)) for r in session.read.parquet(f"{data}/documents.parquet").collect()]
    wanted = {k: (f"{v:016x}", c) for (k, v), c in zip(texts, brute.components(texts), strict=True)}
    rows = QUERIES["op4_simhash_components"](session, data).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == wanted


def test_odd_texts_and_one_of_each(session, odd_docs):
    rows = odd_docs.collect()
    got = odd_docs.select("text", simhash.fingerprints(F.col("text")).alias("f")).collect()
    assert all(r.f == signed(brute.fingerprint(r.text)) for r in got)
    keyed = [(r.doc_id, brute.fingerprint(r.text)) for r in rows]
    kept = simhash.one_of_each(odd_docs.union(odd_docs))
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute.components(keyed)))


def test_rows_without_keys(session):
    docs = session.createDataFrame([(None, "a b c d"), (None, "a b c d"), (None, None)], "doc_id long, text string")
    assert {r.component_id for r in simhash.near_duplicates(docs).collect()} == {None}
    assert simhash.one_of_each(docs).count() == 2
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    assert simhash.one_of_each(docs.limit(0)).collect() == []


def test_components_of_a_long_chain(session):
    edges = session.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(
        session.createDataFrame([(500, 501), (501, 501), (None, 3)], "a long, b long"))
    got = {r.node: r.root for r in smallest_reachable(edges, "a", "b").collect()}
    assert {got.get(n) for n in range(1, 201)} == {0} and got[501] == 500 and len(got) == 201
