"""Line loads in rounds, the order of quality rules, and names that differ in case only."""

import random

import pytest
from pyspark.sql import functions as F

from gradeloom.llm import line_dedup, quality_rules

CLASHES = ["_Drop", "_DROP_ID", "_M", "N_Lines", "KEPT", "Word_Chars", "_r"]


def table(spark, texts, extra=()):
    rows = [(i, t, *["x"] * len(extra)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ", ".join(["doc_id long, text string", *[f"`{c}` string" for c in extra]]))


def lines(seed, n=60):
    rng = random.Random(seed)
    pool = [f"A line that several documents share, number {i}" for i in range(12)]
    return ["\n".join(rng.choice([rng.choice(pool), f"own line {rng.random()} of one document", "short"]) for _ in range(rng.randrange(1, 9))) for _ in range(n)]


def plain(texts):
    owners = {}
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            owners.setdefault(line.strip().lower(), set()).add(i)
    gone = {k: max(o) for k, o in owners.items() if len(k) >= 20 and len(o) >= 3}
    return ["\n".join(line for line in (t or "").split("\n") if gone.get(line.strip().lower(), i) == i) for i, t in enumerate(texts)]


@pytest.mark.parametrize("rounds", [1, 3])
def test_a_load_in_rounds_counts_through_the_filters(spark, monkeypatch, rounds):
    monkeypatch.setattr(line_dedup, "ROUNDS", rounds)
    texts = [*lines(1), None, "", "x" * 40_000]
    docs = table(spark, texts)
    store = line_dedup.LineStore(spark, shard_keys=64)
    store.insert(docs)
    assert store.version == rounds and [r.text for r in store.kept(docs).orderBy("doc_id").collect()] == plain(texts)
    counts = store.table("counts")
    assert counts.count() == counts.select("k1", "k2").distinct().count() == store.table("raw").select("k1", "k2").distinct().count()
    # every key that has a reference is known to the filters of the last round
    assert store.maybe_known(counts.select(*line_dedup.KEY)).where("not known").count() == 0
    if rounds > 1:
        asked = spark.read.parquet(store._at("asked", 2))
        assert asked.where("known").count() > 0 and asked.where("not known").count() > 0
    # inserts and deletes after it go on from there
    more = table(spark, [None] * len(texts) + lines(2, 30)).where(F.col("doc_id") >= len(texts))
    before = sorted(map(tuple, counts.drop("shard").collect()))
    store.insert(more)
    both = texts + lines(2, 30)
    assert [r.text for r in store.kept(table(spark, both)).orderBy("doc_id").collect()] == plain(both)
    store.delete(more.select("doc_id"))
    assert sorted(map(tuple, store.table("counts").drop("shard").collect())) == before


def test_empty_load_and_empty_rounds(spark):
    for texts in ([], ["a line of more than twenty points"]):
        docs = table(spark, texts)
        store = line_dedup.LineStore(spark)
        store.insert(docs)
        assert [r.text for r in store.kept(docs).collect()] == texts


def test_names_that_differ_in_case_only(spark):
    extra = [c for c in CLASHES if c not in ("N_Lines", "KEPT", "Word_Chars")]
    docs = table(spark, lines(3), CLASHES)
    store = line_dedup.LineStore(spark)
    store.insert(docs)
    out = store.kept(docs)
    assert out.count() == 60 and set(extra) <= set(out.columns) and "N_Lines" not in out.columns and "n_lines" in out.columns
    judged = quality_rules.judged(docs)
    row = judged.first()
    assert set(extra) <= set(judged.columns) and row["_M"] == row["_r"] == "x" and "KEPT" not in judged.columns and row["kept"] in (True, False)
    assert set(CLASHES) <= set(quality_rules.keep_good(docs).columns)


def test_cheap_selective_rules_stand_before_dear_ones(spark):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(120)) + (" #$%&" * 40 if i % 3 == 0 else "") for i in range(200)]
    sample = quality_rules.sample_of(table(spark, texts), {})
    rules = {
        "dear": quality_rules.word_measures(F.col("text")).getField("n_repeat_words") > 20,
        "useless": F.col("text").rlike("[^ ]{1001}"),
        "cheap": F.col("text").contains("#$%&"),
    }
    for _ in range(3):
        order = quality_rules.measured_order(sample, rules)
        assert [name for name, _, _ in order] == ["cheap", "dear", "useless"]
        cost = {name: c for name, c, _ in order}
        assert cost["cheap"] < cost["dear"]
    assert quality_rules.measured_order(sample.limit(0), rules) == [(name, 0, 0.0) for name in rules]
