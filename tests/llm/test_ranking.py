import math
import random
from collections import Counter

import numpy as np
import pytest

import brute
from driftline.llm import ranking


def wanted(docs, items, k=50):
    """The contract's integers, document by document: {item place: [(score, key)]} in order."""
    held = [(key, Counter(brute.alnum(text)), len(brute.alnum(text))) for key, text in docs]
    held = [h for h in held if h[2]]
    many, total = len(held), sum(h[2] for h in held)
    df = Counter(t for _, terms, _ in held for t in terms)
    out = []
    for name, text in items:
        terms = set(brute.alnum(text))
        scores = []
        for key, tf, n in held:
            m = 50 + 50 * n * many // total
            score = sum(
                math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m))
                for t in terms if t in tf)
            if score > 0:
                scores.append((-score, key is None, key if key is not None else 0, key))
        scores.sort(key=lambda s: s[:3])
        out += [(name, rank, key, -score) for rank, (score, _, _, key) in enumerate(scores[:k], 1)]
    return Counter(out)


def found(docs, items, **options):
    return Counter(tuple(r) for r in ranking.ranked(docs, items, **options).collect())


@pytest.fixture(scope="module")
def tables():
    draw = random.Random(12)
    word = lambda: f"w{min(int(draw.paretovariate(0.6)), 400)}"
    docs = [(i, " ".join(word() for _ in range(draw.choice([0, 1, 5, 40, 300])))) for i in range(300)]
    docs += [(1000 + i, "w1 w2 w3 tied") for i in range(120)] + [(7, "tied w9")] * 5 + [(None, "tied w9"), (2000, None)]
    items = [(i, " ".join(word() for _ in range(draw.choice([1, 3, 20, 150])))) for i in range(30)]
    items += [(50, "tied"), (51, "Tied, tied!"), (51, "tied"), (52, "absent words"), (53, ""), (54, None), (None, "W9")]
    return docs, items


@pytest.mark.parametrize("options", [
    {}, {"k": 1}, {"k": 1000}, {"block_bytes": 300},
])
def test_ranks_equal_brute_force(session, tables, options):
    docs, items = tables
    frame = session.createDataFrame(docs, "doc_id long, text string").repartition(5)
    queries = session.createDataFrame(items, "item_id long, text string")
    assert found(frame, queries, **options) == wanted(docs, items, options.get("k", 50))


@pytest.mark.parametrize("size", [(1, 1), (3, 7), (64, 2048)])
def test_tiles_change_nothing(session, tables, monkeypatch, size):
    """Tiles are made in the worker: checked on the block itself, against one whole product."""
    monkeypatch.setattr(ranking, "TILE_ITEMS", size[0])
    monkeypatch.setattr(ranking, "TILE_TERMS", size[1])
    block = ranking.Block.of([(i, t) for i, (_, t) in enumerate(tables[1])])
    weights = np.arange(len(block.vocabulary), dtype=float) * 40_000
    impacts = np.random.default_rng(3).integers(0, 10**6, (len(block.vocabulary), 9))
    whole = np.array([(weights[t].astype(int)[:, None] * impacts[t]).sum(axis=0) for _, t in block.items])
    tiled = np.zeros_like(whole)
    for places, pieces in block.tiles(weights):
        for terms, table in pieces:
            tiled[places] += (table @ impacts[terms].astype(float)).astype(np.int64)
    assert (tiled == whole).all()


def test_weights_that_would_round_are_refused():
    block = ranking.Block.of([(0, "a b c")])
    with pytest.raises(ValueError):
        block.tiles(np.full(3, 2.0**52))


def test_length_part_beyond_64_bits():
    n = np.array([1, 10**9, 10**9])
    assert ranking.length_parts(n, 10**12, 10**13).tolist() == [55, 50 + 50 * 10**9 // 10, 50 + 50 * 10**9 // 10]


def test_text_keys_and_odd_rows(session, odd_docs):
    docs = odd_docs.selectExpr("cast(doc_id as string) AS doc_id", "text", "source AS item", "1 AS n", "2 AS score", "3 AS `rank`")
    items = odd_docs.selectExpr("cast(doc_id as string) AS item_id", "text", "'x' AS doc_id", "0 AS _item")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(docs.union(docs), items) == wanted_text(rows * 2, rows)


def wanted_text(docs, items):
    """Text keys order by code point, as numbers of their order do."""
    names = sorted({k for k, _ in docs if k is not None})
    numbered = wanted([(names.index(k) if k is not None else None, t) for k, t in docs], items)
    return Counter({(i, r, names[k] if k is not None else None, s): n for (i, r, k, s), n in numbered.items()})


def test_empty_tables(session, tables):
    docs = session.createDataFrame(tables[0], "doc_id long, text string")
    items = session.createDataFrame(tables[1], "item_id long, text string")
    for some in (ranking.ranked(docs.limit(0), items), ranking.ranked(docs, items.limit(0)),
                 ranking.ranked(docs, items.where("text = ''"))):
        assert some.columns == ["item_id", "rank", "doc_id", "score"] and some.collect() == []
        assert [f.dataType.simpleString() for f in some.schema] == ["bigint", "int", "bigint", "bigint"]
