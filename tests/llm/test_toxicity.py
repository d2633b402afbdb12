import random

import pytest

from driftline.llm import toxicity
from driftline.llm.queries import QUERIES


def maximal(hits, length, drift):
    """Maximal-scoring segments by the recursive definition: best one, then left and right of it."""
    score = [-drift] * length
    for i, s in hits:
        score[i] = s

    def split(lo, hi):
        best = None
        for a in range(lo, hi):
            total = 0.0
            for b in range(a, hi):
                total += score[b]
                if total > 0 and (best is None or total > best[2] + 1e-9):
                    best = (a, b + 1, total)
        return [] if best is None else [*split(lo, best[0]), best, *split(best[1], hi)]

    return split(0, length)


def test_segments_equal_the_definition():
    draw = random.Random(4)
    for _ in range(300):
        length = draw.randrange(1, 40)
        hits = [(i, draw.choice([0.37, 0.91, 2.03])) for i in sorted(draw.sample(range(length), draw.randrange(length // 2 + 1)))]
        got = toxicity.segments(hits, 0.25)
        wanted = maximal(hits, length, 0.25)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in wanted]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in wanted])


@pytest.fixture
def labelled(session):
    """Texts of plain words; toxic ones hold a passage of three out of eight words."""
    draw = random.Random(9)
    plain, bad = [f"w{i}" for i in range(400)], [f"vile{i}" for i in range(8)]
    rows, labels = [], []
    for i in range(600):
        words = [draw.choice(plain) for _ in range(draw.randrange(20, 200))]
        if i % 6 == 0:
            at = draw.randrange(len(words))
            words[at:at] = draw.sample(bad, 3)
        rows.append((i, " ".join(words), 0.5))
        if i % 4:
            labels.append((i, 0, int(i % 6 == 0)))
    docs = session.createDataFrame(rows, "doc_id long, text string, score double")
    return docs, session.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_finds_planted_texts_and_passages(labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    rows = toxicity.scored(docs, model).collect()
    assert {r.doc_id for r in rows if r.toxicity.predicted} == {i for i in range(600) if i % 6 == 0}
    for r in rows:
        assert r.score == 0.5 and 0 <= r.toxicity.score <= 1
        words = r.text.split()
        for p in r.toxicity.passages:
            assert any("vile" in w for w in words[p.start : p.start + p.words])
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 500


def test_held_out_labels_are_not_read(session, labelled):
    docs, labels = labelled
    flipped = labels.selectExpr(
        "doc_id", "quality", "CASE WHEN crc32(CAST(doc_id AS string)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    one, two = (toxicity.train(docs, table) for table in (labels, flipped))
    assert one == two


def test_many_common_words_crowd_out_no_rarer_one(session):
    draw = random.Random(2)
    plain = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(20_000)]
    every = " ".join(plain)  # about 70,000 features in each text
    docs = session.createDataFrame(
        [(i, every + " vile" * (i < 30 and i % 5 < 2)) for i in range(120)], "doc_id long, text string")
    labels = session.createDataFrame([(i, 0, int(i < 30)) for i in range(120)], "doc_id long, quality int, toxic int")
    assert set(toxicity.train(docs, labels).weights) == {b"vile", b"^vile"}


def test_odd_texts_repeated_and_missing_labels(session, labelled, odd_docs):
    docs, labels = labelled
    model = toxicity.train(docs.unionByName(odd_docs.selectExpr("doc_id + 5000 AS doc_id", "text", "0.0D AS score")),
                           labels.union(labels).union(session.createDataFrame([(None, 1, 1), (3, None, None)], labels.schema)))
    rows = toxicity.scored(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and not any(r.toxicity.predicted for r in rows)
    assert len({r.toxicity.score for r in rows if not r.text}) == 1
    nothing = toxicity.train(docs, labels.limit(0))
    assert {r.toxicity.score for r in toxicity.scored(docs, nothing).collect()} == {0.0}
    assert toxicity.scored(odd_docs.limit(0), model).collect() == []
    assert toxicity.train(docs.limit(0), labels) == toxicity.Model()


def test_query_on_held_out_rows(session, data):
    folder = data.replace("sf0.001", "sf0.01")
    rows = {r.doc_id: r for r in QUERIES["op1_toxic_segments"](session, folder).collect()}
    labels = [r for r in session.read.parquet(f"{folder}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert len(rows) == session.read.parquet(f"{folder}/documents.parquet").count()
    right = sum(rows[r.doc_id].predicted == r.toxic for r in labels)
    assert right / len(labels) > 0.9
