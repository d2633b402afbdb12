"""Input columns named like helper or output columns, and keys at the ends of their type."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftline.llm import balancing, chat, exact, licenses, parsing, ranges, ranking, simhash, suffixes, tokens, toxicity
from driftline.llm.queries import tokenizer_path

HELPERS = [
    "_row", "_print", "_words", "_found", "_toxicity", "_again", "_size", "_copies", "_source", "_source_size", "_target",
    "_tie", "_place", "_bucket", "_key", "_text", "_own0", "_own1", "_rank", "_least", "_root", "_part", "_inside", "_before",
    "one", "two", "size", "key", "item", "f", "hits", "found", "fingerprint", "print", "root", "node", "law", "block", "n", "s",
    "_full", "_word", "_bits", "_met", "_length", "_prefix", "_top", "_any", "_named", "_group", "copies", "target",
]
LABELS = [(i, i % 2, i % 2) for i in range(16)]
ITEMS = [(1, "word word word"), (2, None)]
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture
def clashing(odd_docs):
    return odd_docs.select("doc_id", "text", "source", *[F.concat(F.lit("own "), F.lit(c)).alias(c) for c in HELPERS])


def untouched(df, but=()):
    row = df.where("text = 'tab\tsep\r\nline \t x'").first()
    assert [row[c] for c in HELPERS if c not in but] == [f"own {c}" for c in HELPERS if c not in but]


def test_filters_keep_every_column(session, clashing):
    labels = session.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    items = session.createDataFrame(ITEMS, "item_id long, text string")
    for kept in (simhash.one_of_each(clashing), exact.deduplicated(clashing), toxicity.without_toxic(clashing, labels),
                 suffixes.decontaminated(clashing, items), balancing.mixed(clashing)):
        assert kept.columns == clashing.columns
        untouched(kept)


def test_stages_keep_every_column(session, clashing, data):
    for name, stage in STAGES.items():
        out = stage(session, clashing, data)
        assert out.columns == clashing.columns + (["shard", "slot"] if name == "sharding" else [])
        untouched(out)


def test_operators_that_add_columns(session, clashing):
    items = session.createDataFrame(ITEMS, "item_id long, text string")
    untouched(balancing.with_copies(clashing), but=("size", "copies", "target"))
    for blocks in (1 << 20, 4):
        untouched(suffixes.with_matches(clashing, items, block_bytes=blocks), but=("found",))
    untouched(tokens.token_counts(clashing, tokenizer_path()))
    untouched(ranges.shard_documents(clashing, 3))


def test_operators_with_their_own_columns(session, clashing):
    rows = clashing.count()
    items = clashing.select(F.col("doc_id").alias("item_id"), "text", *HELPERS)
    assert exact.exact_groups(clashing).count() == rows
    assert simhash.near_duplicates(clashing).count() == rows
    assert ranges.shard_keys(clashing, 3).count() == rows
    assert licenses.scan(clashing).count() == rows
    assert parsing.compare_with_next(clashing).count() == rows
    assert ranking.ranked(clashing, items).count() > 0
    turns = clashing.selectExpr("doc_id AS conv_id", "1 AS turn", "'user' AS role", "text", *[f"`{c}`" for c in HELPERS])
    assert chat.format_chats(turns).count() == turns.select("conv_id").distinct().count()


EDGES = [(-(1 << 63), "a b c d"), (-(1 << 63) + 1, "a b c d"), ((1 << 63) - 1, "e f g h"), (None, "e f g h"), (0, None)]


def test_keys_at_the_ends_of_their_type(session):
    docs = session.createDataFrame([(k, t, "s") for k, t in EDGES], "doc_id long, text string, source string")
    items = session.createDataFrame([(-(1 << 63), "b c")], "item_id long, text string")
    assert {r.doc_id: r.keep_id for r in exact.exact_groups(docs).collect()}[-(1 << 63)] == -(1 << 63) + 1
    assert simhash.near_duplicates(docs).agg(F.min("component_id")).first()[0] == -(1 << 63)
    assert ranges.shard_keys(docs, 2).count() == len(EDGES)
    assert balancing.mixed(docs).count() >= 1
    assert suffixes.decontaminated(docs, items).count() == 3
    assert [r.doc_id for r in ranking.ranked(docs, items).orderBy("rank").collect()] == [-(1 << 63), -(1 << 63) + 1]
    first = {r.key: r.n_chars for r in parsing.compare_with_next(docs).collect()}
    assert first[-(1 << 63)] == 7 and len(first) == len(EDGES)


@pytest.mark.parametrize("blocks", [1 << 20, 4])
def test_items_with_text_keys(session, blocks):
    docs = session.createDataFrame([(1, "x a b c y"), (2, "é z"), (3, None)], "doc_id long, text string")
    items = session.createDataFrame(
        [("q", "a b c"), ("é", "é"), ("p", "A b c"), ("p", "A b c"), (None, "b c")], "item_id string, text string")
    found = suffixes.with_matches(docs, items, block_bytes=blocks)
    assert {r.doc_id: r.found["items"] for r in found.collect()} == {1: ["p", "q", None], 2: ["é"], 3: []}
