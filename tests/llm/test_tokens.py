import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from driftline.llm import tokens
from driftline.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(path, texts):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(model.encode(t or "")) for t in texts]
    library = Tokenizer.from_file(path)
    return [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_query_equals_library(session, data):
    rows = QUERIES["op2_token_counts"](session, data).collect()
    texts = {r.doc_id: r.text for r in session.read.parquet(f"{data}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in rows} == dict(zip(texts, expected(PATH, texts.values()), strict=True))
    assert all(r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 512) for r in rows)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_odd_texts(session, odd_docs, name):
    path = public_tokenizers.path(name)
    rows = tokens.token_counts(odd_docs, path).collect()
    assert [r.n_tokens for r in rows] == expected(path, [r.text for r in rows])
    assert [r.n_bytes for r in rows] == [len((r.text or "").encode()) for r in rows]


def test_small_caches_change_nothing(odd_docs, monkeypatch):
    texts = [r.text for r in odd_docs.collect()] * 2
    monkeypatch.setattr(tokens, "CHUNK_ENTRIES", 2)
    monkeypatch.setattr(tokens, "PIECE_ENTRIES", 2)
    encoder = tokens.PieceEncoder(PATH, len, sum, {" now": 1})
    assert [encoder.text(t) for t in texts] == expected(PATH, texts)


def test_empty_table(session, odd_docs):
    assert tokens.token_counts(odd_docs.limit(0), PATH).collect() == []


def test_pre_tokens_equal_library():
    library = Tokenizer.from_file(PATH).pre_tokenizer
    to_byte = {letter: byte for byte, letter in tokens.BYTE_LETTERS.items()}
    bits = ["a", "B", "re", "l", "é", "ɏ", "1", " ", " ", "  ", "\n", "\t", "\r", "'", "'s", "'r", "'ve", "'l", "_", ".", "–", "«"]
    draw = random.Random(3)
    texts = ["", "'", "s", "x'", "ll", "a \n", " b", *("".join(draw.choices(bits, k=draw.randrange(12))) for _ in range(20_000))]
    assert not any(tokens.NOT_PLAIN.search(t) for t in texts)
    for some in (pa.array(texts), pa.array(texts).slice(3, 40), pa.array(texts[:1]), pa.array([], pa.string())):
        pieces, places = tokens.pre_tokens(some)
        got = pieces.to_pylist()
        for text, first, last in zip(some.to_pylist(), places, places[1:], strict=False):
            wanted = [bytes(to_byte[c] for c in letters) for letters, _ in library.pre_tokenize_str(text)]
            assert got[first:last] == wanted, text
        assert len(places) == len(some) + 1 and places[-1] == len(got)
