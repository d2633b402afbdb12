import random
import zlib
from functools import reduce

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from driftline.llm import bitplanes, tokens
from driftline.llm.queries import QUERIES
from driftline.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, bitplanes.END_ID]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_planes_round_trip():
    draw = random.Random(1)
    for n in (1, 7, 1000):
        for top in (1, 200, 60_000, 1 << 32):
            data = bitplanes.packed([draw.randrange(top) for _ in range(n)])
            planes = bitplanes.to_planes(data, zstandard.ZstdCompressor())
            assert bitplanes.from_planes(planes, n, zstandard.ZstdDecompressor()) == data


def test_joined_crc():
    draw = random.Random(2)
    parts = [draw.randbytes(4 * draw.randrange(1, 5000)) for _ in range(20)]
    joined = reduce(lambda a, p: (bitplanes.joined_crc(a[0], zlib.crc32(p), len(p)), a[1] + p), parts[1:],
                    (zlib.crc32(parts[0]), parts[0]))
    assert joined[0] == zlib.crc32(joined[1])


def test_query_equals_library(session, data):
    rows = sorted(QUERIES["op6_bit_planes"](session, data).collect())
    start = 0
    for r, d in zip(rows, session.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect(), strict=True):
        ids = ids_of(d.text)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), crc(ids))
        start += len(ids)


@pytest.mark.parametrize("block_ids", [5, 1000])
def test_documents_across_blocks(session, odd_docs, block_ids):
    path = scratch_path(session, "ids")
    docs = odd_docs.where("length(text) < 30000 or text is null")
    bitplanes.write_ids(docs, path, PATH, shards=3, block_ids=block_ids)
    got = sorted((r.doc_key if r.doc_key is not None else -1, r.n_tokens, r.ids_crc32)
                 for r in bitplanes.document_digests(session, path).collect())
    wanted = [(r.doc_id if r.doc_id is not None else -1, ids_of(r.text)) for r in docs.collect()]
    assert got == sorted((k, len(ids), crc(ids)) for k, ids in wanted)
    pieces = bitplanes.read_pieces(session, path).orderBy("shard", "block", "doc_start").collect()
    stream = b"".join(bytes(p.ids) for p in pieces)
    ordered = sorted(wanted, key=lambda w: w[0])
    assert np.frombuffer(stream, "<u4").tolist() == [i for _, ids in ordered for i in ids]
    sizes = [r.n_ids for r in bitplanes.blocks(session, path).orderBy("shard", "block").collect()]
    assert max(sizes) <= block_ids


def test_empty_table(session, odd_docs):
    path = scratch_path(session, "ids")
    bitplanes.write_ids(odd_docs.limit(0), path, PATH)
    assert bitplanes.document_digests(session, path).collect() == []


def test_batch_looks_up_each_pre_token_once(monkeypatch):
    """Words with ever other signs behind them are no work of their own for the cache or the library."""
    draw = random.Random(4)
    words, signs = [f"w{'abcdefghij'[i % 10]}{'xyz'[i // 10]}" for i in range(30)], ["", ".", "!!", "###", ".\nNow", "'s"]
    texts = ["Now " + " ".join(draw.choice(words) + draw.choice(signs) for _ in range(100)) for _ in range(200)]
    encoder, asked = bitplanes._worker_encoder.__wrapped__(PATH), []
    encoder.known = tokens.Kept(lambda piece: asked.append(piece) or encoder._ids(piece), 10_000)
    monkeypatch.setattr(encoder.one, "text", None)  # none of these is encoded by itself
    got = encoder.texts(pa.array(texts))
    assert got == [bitplanes.packed(ids_of(t)[:-1]) for t in texts]
    assert len(asked) == len(set(asked)) <= 1 + len(words) + len(signs) + 1


def test_batches_of_odd_texts(odd_docs, monkeypatch):
    monkeypatch.setattr(bitplanes, "CHUNK_ENTRIES", 2)
    encoder = bitplanes.BatchEncoder(PATH)
    texts = [r.text for r in odd_docs.collect()]
    for some in (texts, texts[1:2] + texts[:1], texts[5:8], texts[10:11]):
        assert encoder.texts(pa.array(some, pa.string())) == [bitplanes.packed(ids_of(t)[:-1]) for t in some]
    assert encoder.texts(pa.array(texts, pa.string()).slice(4, 5)) == [bitplanes.packed(ids_of(t)[:-1]) for t in texts[4:9]]
