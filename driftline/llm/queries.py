"""Registered queries of the corpus operators, each over its whole table, next to its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import (
    balancing,
    bitplanes,
    chat,
    exact,
    licenses,
    parsing,
    ranges,
    ranking,
    simhash,
    spelling,
    suffixes,
    tokens,
    toxicity,
)
from driftline.llm.common import ready
from driftline.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def corpus_query(name: str, sql: str | None = None):
    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(ready(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@corpus_query("op2_token_counts")
def op2(spark, sf_dir):
    counted = tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


PROBE = "<|im_end|><|im_start|>assistant ok"

CHAT_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')),
marked AS (
  SELECT *, length(replace(replace(text, '\\', '\\\\'), '<|', '<\\|')) AS chars,
         length(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '<\\n>')) AS role_chars,
         role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS begins
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (sum(chars) + sum(CASE WHEN begins THEN {len(chat.START)} + role_chars + 1 + {len(chat.END)}
                         ELSE {len(chat.NEXT)} END))::bigint AS formatted_chars,
       count(*) FILTER (begins) AS n_blocks
FROM marked GROUP BY conv_id"""


@corpus_query("op5_chat_formatting", CHAT_SQL)
def op5(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    read = chat.format_chats(given.unionByName(probe)).withColumns(
        {"_turns": chat.turns_of(F.col("formatted")), "_loss": chat.loss_text(F.col("segments"))}
    )
    lines = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_blocks",
    )


@corpus_query("op4_simhash_components")
def op4(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


@corpus_query("op6_bit_planes")
def op6(spark, sf_dir):
    path = scratch_path(spark, "ids")
    bitplanes.write_ids(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return bitplanes.document_digests(spark, path).withColumnRenamed("doc_key", "doc_id")


SHARDS = 8


@corpus_query("op7_sampled_splitters")
def op7(spark, sf_dir):
    sharded = ranges.shard_keys(table(spark, sf_dir, "documents"), SHARDS)
    return sharded.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


@corpus_query("op1_toxic_segments")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs.select("doc_id", "text"), model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "toxicity.score", "toxicity.predicted", F.size("toxicity.passages").alias("n_passages"))


DECONTAMINATION_SQL = r"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
item_split AS (
  SELECT item_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size,
         array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
  FROM item_split, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS gram
  FROM split, sizes, unnest(range(1, len(w) - size + 2)) AS t(i)),
met AS (SELECT doc_id, i, g.size, item_id FROM grams g JOIN windows v ON v.size = g.size AND v.gram = g.gram),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM met) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE "C") AS ids
  FROM (SELECT DISTINCT doc_id, item_id::varchar AS item FROM met) GROUP BY 1)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM split LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)""".replace(' COLLATE "C"', "")


@corpus_query("op3_suffix_decontamination", DECONTAMINATION_SQL)
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffixes.with_matches(docs, table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("found.items", lambda i: i.cast("string")))
    hit = suffixes.hit_words(F.col("found"))
    return found.select(
        "doc_id", "found.n_words", hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


@corpus_query("op8_diagonal_voting")
def op8(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@corpus_query("op9_consistent_parsing")
def op9(spark, sf_dir):
    compared = parsing.compare_with_next(table(spark, sf_dir, "documents"))
    return compared.withColumnRenamed("key", "doc_id")


@corpus_query("op10_entropy_balancing")
def op10(spark, sf_dir):
    taken = balancing.with_copies(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return taken.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


EXACT_SQL = """
WITH hashed AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
     placed AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) AS place,
         max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM hashed)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM placed"""


@corpus_query("op11_progressive_refinement", EXACT_SQL)
def op11(spark, sf_dir):
    return exact.exact_groups(table(spark, sf_dir, "documents"), digest=True)


WORDS_SQL = (
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)
RANKING_SQL = f"""
WITH split AS (SELECT row_number() OVER () AS place, doc_id, {WORDS_SQL} AS w FROM documents),
item_terms AS (
  SELECT DISTINCT place, item_id, unnest({WORDS_SQL}) AS term
  FROM (SELECT row_number() OVER () AS place, * FROM benchmark)),
sizes AS (SELECT place, doc_id, len(w)::bigint AS n FROM split WHERE len(w) > 0),
totals AS (SELECT count(*) AS docs, sum(n)::bigint AS words FROM sizes),
tf AS (SELECT place, term, count(*) AS tf FROM (SELECT place, unnest(w) AS term FROM split)
       WHERE term IN (SELECT term FROM item_terms) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint AS w
  FROM tf, totals GROUP BY term, docs),
impacts AS (
  SELECT tf.place, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))) AS part
  FROM tf JOIN sizes USING (place) JOIN weights USING (term), totals),
scores AS (
  SELECT i.place AS item, item_id, d.place, doc_id, sum(part)::bigint AS score
  FROM item_terms i JOIN impacts d USING (term) GROUP BY ALL HAVING sum(part) > 0),
ranks AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::int AS rank FROM scores)
SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= {ranking.TOP}"""


@corpus_query("op12_blocked_products", RANKING_SQL)
def op12(spark, sf_dir):
    return ranking.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# CRC-32 byte by byte; its table follows from the polynomial.
SPELLING_SQL = """
WITH RECURSIVE bits AS (
  SELECT i::bigint AS b, i::bigint AS v, 0 AS step FROM range(256) t(i)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE step = 8),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  GROUP BY ALL),
hashed AS (
  SELECT run, times, xor(list_reduce(
           list_prepend(4294967295::bigint, list_transform(range(1, octet_length(encode(doc_id || ':' || run)) + 1),
             lambda i: ('0x' || substr(hex(doc_id || ':' || run), 2 * i - 1, 2))::bigint)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM runs, crc),
words AS (
  SELECT word, sum(times)::bigint AS n
  FROM (SELECT times, CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2)
                           ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
cut AS (
  SELECT word, n, length(word) AS size, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM words, unnest(range(1, length(word) + 1)) AS u(i)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.size = b.size
  WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS top, arg_min(other, (-other_n, encode(other))) AS near FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * w.n THEN near END AS form,
         CASE WHEN top >= 2 * w.n THEN top END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root, form AS next, 0 AS depth FROM forms
  UNION ALL SELECT c.word, f.word, f.form, depth + 1 FROM chain c JOIN forms f ON c.next = f.word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, root FROM chain WHERE next IS NULL) USING (word)"""


@corpus_query("op13_reduced_alphabets", SPELLING_SQL)
def op13(spark, sf_dir):
    found = spelling.runs(table(spark, sf_dir, "documents"))
    words = found.select(spelling.misspelt(F.col("run"), F.col("key")).alias("word"))
    return spelling.variants(spelling.vocabulary(words))


@corpus_query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
