import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from driftline.llm import parsing
from driftline.llm.queries import QUERIES


def some_text(seed, n=3000):
    draw = random.Random(seed)
    return "".join(draw.choice("abcdefgh  é,") for _ in range(n))


def test_equal_substrings_share_phrases_at_any_offset():
    core, noise = some_text(1), some_text(2)
    plain = parsing.sketches([core.encode()])[0]
    for offset in (1, 2, 3, 7, 100):
        moved = parsing.sketches([(noise[:offset] + core).encode()])[0]
        assert parsing.likeness(plain, moved) > 0.85
    assert parsing.likeness(plain, parsing.sketches([noise.encode()])[0]) < 0.1


def test_texts_do_not_influence_each_other():
    texts = [b"", b"a", b"aa", b"a" * 5000, some_text(3).encode(), "é🙂".encode(), b"ab" * 3000, some_text(4, 50).encode()]
    together = parsing.sketches(texts)
    for text, row in zip(texts, together, strict=True):
        assert np.array_equal(parsing.sketches([text])[0], row)
    assert not together[0].any() and together[1:].any(axis=1).all()


def test_likeness_follows_the_shared_part():
    core = some_text(5, 20_000)
    near = [parsing.likeness(*parsing.sketches([core.encode(), (core[:k] + some_text(6, 20_000 - k)).encode()]))
            for k in (0, 5_000, 10_000, 15_000, 20_000)]
    assert near == sorted(near) and near[0] < 0.1 and near[-1] == 1


def expected(rows):
    """Rows of (key, text) -> (key, chars, digest of the edited text) and the next text."""
    out = []
    for i, (key, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        third = len(text) // 3
        out.append((key, len(text), hashlib.sha256((text[: len(text) - third] + following[:third]).encode()).hexdigest()))
    return out


def test_query_equals_brute_force(session, data):
    docs = [(r.doc_id, r.text or "") for r in session.read.parquet(f"{data}/documents.parquet").orderBy(F.desc("doc_id")).collect()]
    rows = {r.doc_id: r for r in QUERIES["op9_consistent_parsing"](session, data).collect()}
    assert len(rows) == len(docs)
    for (key, chars, digest), (_, text) in zip(expected(docs), docs, strict=True):
        r = rows[key]
        assert (r.n_chars, r.edited_sha256) == (chars, digest)
        assert r.fingerprint == parsing.sketches([text.encode()])[0].tobytes().hex()
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    marks = {k: np.frombuffer(bytes.fromhex(r.fingerprint), dtype=np.uint16) for k, r in rows.items()}
    for i, (key, _) in enumerate(docs):
        assert rows[key].near_next == parsing.likeness(marks[key], marks[docs[(i + 1) % len(docs)][0]])
    assert np.mean([r.near_edited > r.near_next for r in rows.values()]) > 0.95


def test_odd_rows_ties_and_clashing_names(session, odd_docs):
    docs = odd_docs.union(odd_docs.where("doc_id > 3")).withColumns({"_part": F.lit(1), "fingerprint": F.lit("old")})
    rows = parsing.compare_with_next(docs).collect()
    assert len(rows) == docs.count()
    assert sorted(r.n_chars for r in rows) == sorted(len(r.text or "") for r in docs.collect())
    by_text = {}
    for r in docs.select("text", parsing.fingerprints(F.col("text")).alias("f")).collect():
        assert by_text.setdefault(r.text or "", r.f) == r.f


def test_one_row_and_none(session, odd_docs):
    one, = parsing.compare_with_next(odd_docs.where("doc_id = 5")).collect()
    assert (one.near_next, one.n_chars) == (1.0, 6)
    assert parsing.compare_with_next(odd_docs.limit(0)).collect() == []
