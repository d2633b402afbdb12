import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from driftline.llm import spelling


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    longer, shorter = (a, b) if len(a) > len(b) else (b, a)
    return any(longer[:i] + longer[i + 1 :] == shorter for i in range(len(longer)))


def wanted(counts, ratio=2):
    """(word, form, root, n, n_near, form_n) of every word, all pairs compared."""
    forms, out = {}, []
    for word, n in counts.items():
        others = [o for o in counts if near(word, o)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        forms[word] = best if best is not None and counts[best] >= ratio * n else None
        out.append((word, len(others)))
    rows = []
    for word, many in out:
        root = word
        while forms[root] is not None:
            root = forms[root]
        rows.append((word, forms[word], root, counts[word], many, counts[forms[word]] if forms[word] else None))
    return sorted(rows)


def contract_words(docs, chars=5, least=3):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(brute.UPPER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= chars and n >= least}


@pytest.fixture(scope="module")
def words():
    """Words, their misspellings in chains of growing counts, ties, runs of one letter, long and odd letters."""
    draw = random.Random(13)
    letters, counts = "abcdeé", {}
    for _ in range(120):
        word = "".join(draw.choice(letters) for _ in range(draw.choice([5, 5, 6, 7, 12])))
        n = draw.choice([3, 4, 100])
        for _ in range(5):
            counts[word] = n
            place, n = draw.randrange(len(word)), n * draw.choice([1, 2, 3])
            word = draw.choice([word[:place] + word[place + 1 :], word[:place] + draw.choice(letters) + word[place:],
                                word[:place] + draw.choice(letters) + word[place + 1 :]])
    for n in range(5, 15):
        counts["z" * n] = 3 << n
    counts |= {"y" * 5000: 3, "y" * 4999 + "x": 6, "ÿÿÿÿÿ": 4, "ÿÿÿÿy": 8, "𝒶𝒷𝒸𝒹𝑒": 3, "𝒶𝒷𝒸𝒹": 9}
    return counts


def found(session, counts):
    rows = session.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    return sorted(tuple(r) for r in spelling.variants(rows).collect())


def test_variants_equal_brute_force(session, words):
    assert found(session, words) == wanted(words)


@pytest.mark.parametrize("symbols, bits", [(1, 27), (2, 12), (5, 6), (16, 27)])
def test_symbols_and_bitmap_change_nothing(session, words, monkeypatch, symbols, bits):
    monkeypatch.setattr(spelling, "FEWEST_BITS", bits)
    monkeypatch.setattr(spelling, "MOST_BITS", bits)
    rows = session.createDataFrame(list(words.items()), "word string, n long")
    pairs = sorted((r.word, r.other) for r in spelling.near_words(rows, symbols).collect())
    assert pairs == sorted((a, b) for a in words for b in words if near(a, b))


def test_no_join_is_broadcast(session, words, monkeypatch):
    """Sizes that Spark supposes, all of them below its limit here, never send a table to the driver."""
    plans, write = [], spelling.written

    def written(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(spelling, "written", written)
    before = session.conf.get("spark.sql.autoBroadcastJoinThreshold")
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        made = spelling.variants(session.createDataFrame(list(words.items()), "word string, n long"))
        assert sorted(tuple(r) for r in made.collect()) == wanted(words)
    finally:
        session.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plans.append(made._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 4
    assert not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("word", ["a", "ab", "aaaa", "abcabc", "zzyzzyyy", "é𝒶bc"])
def test_neighbourhood_is_whole_and_made_once(word):
    symbols = 3
    [(_, symbol_rows)] = spelling._by_length([word], symbols)
    own = symbol_rows[0].tolist()
    edits = {tuple(own)} | {tuple(own[:i] + own[i + 1 :]) for i in range(len(own))}
    edits |= {(*own[:i], s, *own[i:]) for i in range(len(own) + 1) for s in range(symbols)}
    edits |= {(*own[:i], s, *own[i + 1 :]) for i in range(len(own)) for s in range(symbols)}
    power = [pow(int(spelling._BASE[0]), i, 1 << 64) for i in range(len(own) + 1)]
    hashed = {sum(int(spelling.CODES[s]) * p for s, p in zip(e, power, strict=False)) % (1 << 64) for e in edits}
    [hashes], [wanted] = spelling.neighbourhoods(symbol_rows, symbols)
    made = hashes[wanted]
    assert len(made) == len(edits) and set(made.tolist()) == hashed
    assert made[0] == spelling.reduced_hashes(["other", word, ""], symbols)[1]


def test_words_of_the_contract(session, odd_docs):
    texts = [(i, f"Straße Naïve naive NAIVE naïve word{i} words words wörds × ÷ Ünïcode {'Ünïcode ' * (i % 4)}") for i in range(300)]
    rows = texts + [(r.doc_id, r.text) for r in odd_docs.collect()]
    docs = session.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("x")).withColumn("run", F.lit(1))
    runs = spelling.runs(docs)
    made = spelling.vocabulary(runs.select(spelling.misspelt(F.col("run"), F.col("key")).alias("word")))
    expected = contract_words(rows)
    assert {r.word: r.n for r in made.collect()} == expected and any(zlib.crc32(f"{i}:words".encode()) % 97 == 0 for i, _ in texts)
    assert sorted(tuple(r) for r in spelling.variants(made).collect()) == wanted(expected)


def test_empty_and_null_words(session):
    none = session.createDataFrame([], "word string, n long")
    assert spelling.variants(none).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.variants(none).collect() == []
    odd = session.createDataFrame([(None, 9), ("", 3), ("a", 6)], "word string, n long")
    assert sorted((tuple(r) for r in spelling.variants(odd).collect()), key=str) == sorted(
        [(None, None, None, 9, 0, None), ("", "a", "a", 3, 1, 6), ("a", None, "a", 6, 1, None)], key=str)


def test_symbols_grow_slowly():
    assert [spelling.symbols_for(n) for n in (0, 1, 4096, 10**6, 10**9)] == [4, 4, 4, 10, 16]
    assert np.unique(spelling.CODES).size == spelling.MOST_SYMBOLS
