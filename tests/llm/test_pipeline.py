import brute
import pytest

import corpus_pipeline
from driftline.llm import toxicity
from driftline.llm.common import written


@pytest.fixture(scope="module")
def steps(spark, data):
    """What each stage was given and what it returned."""
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = written(stage(spark, docs, data), "step")
        out[name] = (docs, made)
        docs = made
    return out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "source").collect()]


def test_all_but_the_last_keep_the_columns(steps):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert [out.columns for _, out in steps.values()] == [columns] * 4 + [[*columns, "shard", "slot"]]


def test_toxic_documents_go(spark, steps, data):
    given, out = steps["toxicity"]
    model = toxicity.train(given, spark.read.parquet(f"{data}/labels.parquet"))
    clean = [r.doc_id for r in toxicity.scored(given, model).collect() if not r.toxicity.predicted]
    assert sorted(r[0] for r in rows(out)) == sorted(clean)


def test_one_of_each_group_stays(steps):
    given, out = steps["near-duplicates"]
    keyed = [(k, brute.fingerprint(t)) for k, t, _ in rows(given)]
    assert sorted(r[0] for r in rows(out)) == sorted(set(brute.components(keyed)))


def test_contaminated_documents_go(spark, steps, data):
    given, out = steps["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 10]) for _, t in items for w in [brute.alnum(t)] for i in range(len(w) - 9)}
    held = lambda t: any(tuple(w[i : i + 10]) in grams for w in [brute.alnum(t)] for i in range(len(w) - 9))
    assert sorted(r[0] for r in rows(out)) == sorted(k for k, t, _ in rows(given) if not held(t))


def test_sources_meet_their_targets(steps):
    given, out = steps["mixing"]
    size = lambda df: {s: sum(len(brute.spaced(t)) for _, t, o in rows(df) if o == s) for s in {r[2] for r in rows(df)}}
    wanted, taken = brute.targets(size(given)), size(out)
    longest = max(len(brute.spaced(t)) for _, t, _ in rows(given))
    assert all(abs(taken.get(s, 0) - wanted[s]) <= longest for s in wanted)
    assert max(brute.count_rows(rows(out)).values()) <= 2


def test_shards_hold_all_rows(steps):
    given, out = steps["sharding"]
    assert brute.count_rows(rows(given)) == brute.count_rows(rows(out))
    slots = {}
    for r in out.select("shard", "slot").collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_equals_the_stages(spark, steps, data):
    last = steps["sharding"][1]
    assert brute.count_rows(corpus_pipeline.run(spark, data).collect()) == brute.count_rows(last.collect())


def test_stages_take_empty_and_odd_tables(session, odd_docs, data):
    docs = odd_docs.selectExpr("doc_id", "text", "'xx' AS lang", "source", "length(text) AS n_chars")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(session, docs.limit(0), data).collect() == []
        assert stage(session, docs, data).count() > 0, name
