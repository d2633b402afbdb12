import hashlib
from collections import Counter, defaultdict

import pytest

from driftline.llm import exact
from driftline.llm.common import lower_ascii


def wanted(rows):
    """(key, text) rows -> counts of (key, keep, size, kept, digest), each text compared whole."""
    groups = defaultdict(list)
    for key, text in rows:
        groups[text or ""].append(key)
    out = Counter()
    for text, keys in groups.items():
        named = [k for k in keys if k is not None]
        keep = max(named) if named else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        for key in keys:
            out[key, keep, len(keys), False, digest] += 1
        out[keep, keep, len(keys), False, digest] -= 1
        out[keep, keep, len(keys), True, digest] += 1
    return +out


def found(df, **options):
    return Counter(tuple(r) for r in exact.exact_groups(df, digest=True, **options).collect())


LONG = "a" * 64
CASES = [
    (1, "same"), (5, "same"), (3, "same"), (3, "same"), (2, "emas"), (4, None), (6, ""), (7, " "), (8, None),
    (9, LONG + "x"), (10, LONG + "y"), (11, LONG + "x"), (12, LONG), (None, "same"), (None, "nobody"), (None, "nobody"),
    (13, "é" * 3), (14, "é" * 3), (15, "Ab"), (16, "aB"), (-(1 << 63), "edge"), ((1 << 63) - 1, "edge"),
]


@pytest.mark.parametrize("words", [1, 1 << 20])
def test_groups_equal_brute_force(session, monkeypatch, words):
    """A bitmap of one word lets nearly every row through and changes nothing."""
    monkeypatch.setattr(exact, "WORDS", words)
    assert found(session.createDataFrame(CASES, "doc_id long, text string").repartition(3)) == wanted(CASES)


def test_normalised_texts(session):
    docs = session.createDataFrame(CASES, "doc_id long, text string")
    lowered = [(k, t.lower() if t else t) for k, t in CASES]
    assert found(docs, normal=lower_ascii) == wanted(lowered)


def test_large_group_of_one_key(session):
    rows = [(7, "again and again")] * 400 + [(i, f"text {i}") for i in range(200)]
    assert found(session.createDataFrame(rows, "doc_id long, text string").repartition(8)) == wanted(rows)


def test_text_keys(session):
    rows = [("b", "x"), ("a", "x"), (None, "x"), ("é", "y"), ("z", "y")]
    assert found(session.createDataFrame(rows, "doc_id string, text string")) == wanted(rows)


def test_odd_rows_keep_their_columns(session, odd_docs):
    clash = ["_row", "_full", "_key", "_word", "_bits", "_size", "_top", "kept"]
    docs = odd_docs.select("*", *[odd_docs.doc_id.cast("string").alias(c) for c in clash])
    kept = exact.deduplicated(docs.union(docs))
    assert kept.columns == docs.columns
    own = [tuple(r) for r in kept.collect()]
    assert all(r[len(odd_docs.columns):] == (None if r[0] is None else str(r[0]),) * len(clash) for r in own)
    assert sorted(r[1] or "" for r in own) == sorted({r.text or "" for r in docs.collect()})
    assert found(docs) == wanted([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(session, odd_docs):
    assert exact.exact_groups(odd_docs.limit(0)).columns == ["doc_id", "keep_id", "group_size", "kept"]
    assert exact.exact_groups(odd_docs.limit(0)).collect() == exact.deduplicated(odd_docs.limit(0)).collect() == []


def test_main_path_has_no_python(session, data):
    docs = session.read.parquet(f"{data}/documents.parquet")
    plan = exact.exact_groups(docs, digest=True)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
