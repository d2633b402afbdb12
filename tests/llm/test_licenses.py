import brute

from driftline.llm import licenses
from driftline.llm.queries import QUERIES

FILLER = "and of the in a word or two by which nothing is said "


def base_places(text):
    words = brute.alnum(text)
    found = []
    for phrase, label in licenses.BASE_PHRASES.items():
        own = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    return len(words), sorted(found)


def assert_base(row, text):
    n, found = base_places(text)
    assert (row.n_words, row.n_base) == (n, len(found))
    assert (row.first_word, row.last_word) == ((found[0][0], found[-1][0]) if found else (None, None))
    assert row.base_labels == ",".join(sorted({label for _, label in found}))
    assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(","))
    assert 0 <= row.score <= 1


def test_query_equals_brute_force(session, data):
    texts = {r.doc_id: r.text for r in session.read.parquet(f"{data}/documents.parquet").collect()}
    rows = QUERIES["op8_diagonal_voting"](session, data).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert_base(r, texts[r.doc_id])
        lowered = " ".join(brute.alnum(texts[r.doc_id]))
        assert ("cc-by-nc" in r.labels.split(",")) == ("licensed under cc by nc 4 0" in lowered)


def scanned(session, texts):
    docs = session.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, label string, pos int")
    return [r for r in licenses.scan(docs).orderBy("doc_id").collect()]


def test_templates_with_edits(session):
    bsd = next(t for label, t in licenses.TEMPLATES if label == "bsd")
    words = bsd.split()
    texts = [
        FILLER * 30 + bsd.upper() + ". " + FILLER, FILLER + " ".join([*words[:9], "really", *words[9:]]),
        FILLER + " ".join(words[:5]), FILLER + " ".join(words[:12]), "all rights reserved " * 3,
        "Licensed under CC BY 4.0", "licensed under cc by-nc-sa 4.0!", "MIT-License mit license " + FILLER * 400,
    ]
    labels = [r.labels for r in scanned(session, texts)]
    assert labels == ["bsd", "bsd", "", "", "all-rights-reserved", "cc-by", "cc-by-nc-sa", "mit"]
    assert all(0 < r.score <= 1 for r in scanned(session, texts) if r.labels)


def test_odd_texts_and_repeated_rows(session, odd_docs):
    twice = odd_docs.union(odd_docs).union(odd_docs.where("doc_id = 1"))
    rows = licenses.scan(twice).collect()
    assert len(rows) == twice.count()
    by_key = {}
    for r in rows:
        by_key.setdefault(r.doc_id, r)
        assert by_key[r.doc_id] == r
    for r in odd_docs.collect():
        assert_base(by_key[r.doc_id], r.text)
    assert licenses.scan(odd_docs.limit(0)).collect() == []


def test_many_base_places(session):
    row, = scanned(session, ["mit license, apache license; General Public License " * 2000])
    assert_base(row, "mit license, apache license; General Public License " * 2000)
