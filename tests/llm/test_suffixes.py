import hashlib

import pytest

from driftline.llm import suffixes
from driftline.llm.queries import QUERIES
import brute

LONG = "one two three four five six seven eight nine ten eleven twelve thirteen"
ITEMS = [
    (1, LONG), (2, LONG.upper() + "!"), (3, "short ITEM, here"), (4, None), (5, "..."), (6, "a b a b a b a b a b a b"),
    (7, "solo"), (None, "no key but three four five six seven eight nine ten eleven twelve"),
]
TEXTS = [
    None, "", "nothing of it", LONG, "x " + LONG.replace("one", "uno") + " y", "three four five six seven eight nine ten eleven",
    "short item here short-item-here", "a b " * 30, "solo " * 3, LONG + " " + LONG, "ten words " + LONG[4:] + " é solo",
    "short item " * 5, LONG * 400,
]


@pytest.fixture
def tables(session):
    docs = session.createDataFrame(
        [(i, t, "clash", "clash") for i, t in enumerate([*TEXTS, TEXTS[3]])], "doc_id long, text string, found string, item_id string")
    return docs, session.createDataFrame(ITEMS, "item_id long, text string")


def expected(text):
    n, places, found = brute.hits(text, ITEMS)
    return n, len(places), {k for k in found}


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_matches_equal_brute_force(tables, block_bytes):
    docs, items = tables
    rows = suffixes.with_matches(docs, items, block_bytes=block_bytes, name="m").collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        got = (r.m.n_words, sum(h.words for h in r.m.hits), set(r.m["items"]))
        assert got == expected(r.text), r.text[:80]
        assert r.found == r.item_id == "clash"


def test_longest_match_and_place(tables):
    docs, items = tables
    row = {r.doc_id: r.m for r in suffixes.with_matches(docs, items, name="m").collect()}
    assert row[3].longest == 13 and [(h.start, h.words) for h in row[3].hits] == [(0, 13)]
    assert row[4].longest == 12 and [(h.start, h.words) for h in row[4].hits] == [(2, 12)]
    assert row[9].longest == 13


def test_decontaminated_keeps_clean_rows(tables):
    docs, items = tables
    kept = suffixes.decontaminated(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, t in enumerate([*TEXTS, TEXTS[3]]) if not expected(t)[1]}


def test_query_equals_brute_force(session, data):
    read = lambda name: session.read.parquet(f"{data}/{name}.parquet")
    items = [tuple(r) for r in read("benchmark").collect()]
    texts = {r.doc_id: r.text for r in read("documents").collect()}
    rows = {r.doc_id: r for r in QUERIES["op3_suffix_decontamination"](session, data).collect()}
    assert any(r.contaminated for r in rows.values())
    for key, text in list(texts.items())[::4] + [(k, texts[k]) for k, r in rows.items() if r.contaminated]:
        n, places, found = brute.hits(text[:20_000], items) if not rows[key].contaminated else brute.hits(text, items)
        r = rows[key]
        assert (r.n_hit, r.n_items, r.contaminated) == (len(places), len(found), bool(places))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()


def test_empty_tables(session, tables):
    docs, items = tables
    assert suffixes.with_matches(docs.limit(0), items).collect() == []
    assert all(r.m.n_words == len(brute.alnum(r.text)) and not r.m.hits
               for r in suffixes.with_matches(docs, items.limit(0), name="m").collect())
