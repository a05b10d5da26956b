import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradeloom.functions import text as X
from gradeloom.operators import scoring
from gradeloom.operators.prompts import resolve_prompts
from gradeloom.operators.testsets import spread_prompts
from gradeloom.plans import review
from gradeloom.schema import AXES, VARIANTS

POOL = "ordinal int, id string, statement string, instruction string, variant string, variant_summary string, required_moves array<string>"


def wire(score, drop=None):
    return json.dumps({
        "compliance": {"variant": "statement", "moves": []}, "holisticScore": score, "raterCommentary": f"commentary for {score}",
        "axisAssessments": {a: {"score": 4, "evidence": "e", "reasoning": "r"} for a in AXES if a != drop},
        "confidenceRange": {"low": score - 0.5, "high": score + 0.5},
        "suggestions": [{"priority": i, "axis": "position", "problem": "p", "fix": "f", "example": ""} for i in (1, 2, 3, 3)]})


def scorer(texts, refusal=None):
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        out = batch[["item_id", "sample_idx"]].copy()
        out["text"] = [texts[i % len(texts)] for i in batch["sample_idx"]]
        out["refusal"] = refusal
        out["input"], out["cached"], out["cache_write"], out["output"] = 9000, 8500, 0, 1200
        return out
    return run


@pytest.fixture(scope="module")
def pool(spark):
    rows = [(i, f"t{i}", s, f"Write a response in which {v}", v, "s", ["a", "b", "c"]) for i, (s, v) in enumerate([
        ("Only once stated.", "policy"), ("Stated twice.", "two_views"), ("Stated twice.", "statement"), ("Last.", "policy")])]
    return spark.createDataFrame(rows, POOL)


@pytest.fixture(scope="module")
def prefixes(spark):
    return spark.createDataFrame([("all", "constant prefix")], "context_id string, prefix string")


def test_resolver(spark, pool):
    rows = [("a", "x", "discuss which view more closely aligns", None), ("b", "only  ONCE stated.", None, None), ("c", "Stated twice.", None, None),
            ("d", "Stated twice.", None, "policy"), ("e", "unknown", "nothing", None)]
    got = {r["id"]: r for r in resolve_prompts(spark.createDataFrame(rows, "id string, statement string, instruction string, variant string"), pool).collect()}
    assert got["a"]["variant"] == "two_views" and got["b"]["variant"] == "policy" and got["b"]["resolved_statement"] == "Only once stated."
    assert "two_views, statement" in got["c"]["resolution_error"] and got["c"]["variant"] is None
    assert got["d"]["variant"] == "policy" and got["d"]["resolved_instruction"] == "Write a response in which policy"
    assert got["e"]["resolution_error"].startswith("cannot determine")


def items(spark, essay="A genuine answer about several things."):
    return spark.createDataFrame([("i1", "Only once stated.", essay)], "item_id string, statement string, essay string")


def test_consensus_and_usage(spark, pool, prefixes):
    r = review.review_batch(items(spark), pool, prefixes, scorer([wire(4), wire(5), wire(5)]), samples=3).first()
    assert r["consensus"] == 5.0 and r["commentary"] == "commentary for 5" and r["samples"] == [4.0, 5.0, 5.0] and r["calls"] == 3
    assert r["review"]["holistic_score"] == 5.0 and len(r["review"]["axis_assessments"]) == 5 and len(r["review"]["suggestions"]) == 4
    two = review.review_batch(items(spark), pool, prefixes, scorer([wire(4), wire(4)]), samples=2).first()
    assert (two["cached"], two["output"]) == (17000, 2400)


@pytest.mark.parametrize("texts,refusal,expect", [
    ([wire(4)], "policy", "declined"), (["not json"], None, "not JSON"), (["{}"], None, "no numeric holisticScore"),
    (['{"holisticScore": 4}'], None, "no axisAssessments"), ([wire(4, drop="language")], None, '"language" axis')])
def test_failures_stay_as_rows(spark, pool, prefixes, texts, refusal, expect):
    r = review.review_batch(items(spark), pool, prefixes, scorer(texts, refusal)).first()
    assert r["consensus"] is None and expect in r["error"]


def test_zero_makes_no_call(spark, pool, prefixes):
    def forbidden(batch):
        assert batch.empty
        return scorer([wire(1)])(batch)
    r = review.review_batch(items(spark, "  \n "), pool, prefixes, forbidden).first()
    assert (r["consensus"], r["calls"], r["samples"], r["input"]) == (0.0, 0, [0.0], 0) and "empty" in r["commentary"]


def test_prefix_contexts(spark):
    rows = [(i, f"g{i % 2}_score{i}", float(i), f"g{i % 2}", f"essay {i}", "st", "in", "rc") for i in range(1, 5)]
    anchors = spark.createDataFrame(rows, "ordinal int, id string, score double, group string, essay string, prompt_statement string, prompt_instruction string, rater_commentary string")
    rubric = scoring.render_rubric(spark.createDataFrame([(6, "Sum", 0, "position", "desc"), (0, "Zero", None, None, None)], "score int, summary string, axis_no int, axis string, descriptor string"))
    assert rubric.first()[0] == "SCORE 6\nSum\n  - [position] desc\n\nSCORE 0\nZero"
    a = {r["context_id"]: r for r in scoring.render_prefixes(anchors, rubric).collect()}
    b = {r["context_id"]: r for r in scoring.render_prefixes(anchors, rubric).collect()}
    assert {k: v["prefix_key"] for k, v in a.items()} == {k: v["prefix_key"] for k, v in b.items()} and set(a) == {"all", "without:g0", "without:g1"}
    text = a["without:g0"]["prefix"]
    assert "g1_score3" in text and "g0_score2" not in text and text.index("g1_score3") < text.index("g1_score1")
    parts = scoring.prefix_parts(anchors, rubric).toPandas()
    assert len(parts) == 5
    for context, withheld in (("all", None), ("without:g0", "g0"), ("without:g1", "g1")):
        assert scoring.assemble_prefix(parts, withheld) == a[context]["prefix"]
    assert set(r["context_id"] for r in scoring.render_prefixes(anchors, rubric, leave_group_out=False).collect()) == {"all"}
    none = scoring.render_prefixes(anchors.where("false"), rubric).collect()
    assert [(r["context_id"], r["prefix"][-20:]) for r in none] == [("all", "\n\n# Scored examples\n\n"[-20:])]


def test_prefix_pieces_put_together_are_the_prefix(spark):
    # equal places, a group of None and one that holds the first anchors alone
    rows = [(o, f"a{i}", s, g, f"essay {i}", "st", "in", "rc") for i, (o, s, g) in enumerate(
        [(1, 6.0, "top"), (2, 6.0, "top"), (3, 5.0, "g"), (3, 5.0, "g"), (4, 4.0, None), (5, 1.0, "low")])]
    anchors = spark.createDataFrame(rows, "ordinal int, id string, score double, group string, essay string, prompt_statement string, prompt_instruction string, rater_commentary string")
    rubric = spark.createDataFrame([("R",)], "rubric string")

    def together(a):
        parts = scoring.prefix_parts(a, rubric)
        got = scoring.prefix_pieces(parts).toPandas().sort_values("place", kind="stable")
        return parts.toPandas(), {k: "".join(p["text"]) for k, p in got.groupby(["context_id", "by_group"])}
    parts, got = together(anchors)
    assert set(got) == {("all", False), ("all", True), *((f"without:{g}", True) for g in ("top", "g", "low"))}
    for (context, _), text in got.items():
        want = scoring.assemble_prefix(parts, None if context == "all" else context[len("without:"):])
        assert len(text) == len(want) and sorted(text.split(scoring.JOINT)[1:]) == sorted(want.split(scoring.JOINT)[1:])
    parts, got = together(anchors.where("group = 'low'"))
    assert got == {("all", False): scoring.assemble_prefix(parts), ("without:low", True): scoring.assemble_prefix(parts, "low")}
    parts, got = together(anchors.where("false"))
    assert got == {("all", False): scoring.assemble_prefix(parts)}


def test_anchors_travel_once_per_core_at_most(spark):
    calls = spark.range(1000).select(F.col("id").cast("string").alias("item_id"), F.concat(F.lit("without:g"), "id").alias("context_id"))
    assert scoring.call_pieces(calls, 1) == spark.sparkContext.defaultParallelism
    assert (scoring.call_pieces(calls, 600), scoring.call_pieces(calls.limit(0))) == (2, 1)


def test_prefix_travels_by_join_when_large(spark, prefixes):
    seen = spark.createDataFrame([("i", "all", "r")], "item_id string, context_id string, request string")

    def echo(batch):
        return scorer([wire(3)])(batch).assign(text=batch["prefix"])
    for limit in (0, 1000):
        assert scoring.call_scorer(seen, prefixes, echo, max_bytes=limit).first()["text"] == "constant prefix"


def test_calls_meet_whole_anchors_in_every_piece(spark):
    rows = [(i, f"g{i % 3}_score{i}", float(i % 4), f"g{i % 3}", f"essay {i} " * 50, "st", "in", "rc") for i in range(12)]
    anchors = spark.createDataFrame(rows, "ordinal int, id string, score double, group string, essay string, prompt_statement string, prompt_instruction string, rater_commentary string")
    rubric = spark.createDataFrame([("R",)], "rubric string")
    parts = scoring.prefix_parts(anchors, rubric)
    # one context holds most calls, others one each; an unknown group withholds nothing; no context means all anchors
    contexts = ["without:g0"] * 60 + ["without:g1", "all", "without:nobody", None] + [f"without:x{i}" for i in range(10)]
    calls = spark.createDataFrame([(f"i{i}", c, f"r{i}") for i, c in enumerate(contexts)], "item_id string, context_id string, request string")

    def echo(batch):
        return scorer([wire(3)])(batch).assign(text=batch["context_id"] + "|" + batch["prefix"], output=len(batch))
    want = {r["context_id"]: r["prefix"] for r in scoring.render_prefixes(anchors, rubric).collect()}
    for piece_calls in (7, 1000):
        got = scoring.call_with_anchors(calls, parts, echo, samples=2, piece_calls=piece_calls).collect()
        assert sorted((r["item_id"], r["sample_idx"]) for r in got) == sorted((f"i{i}", s) for i in range(len(contexts)) for s in (0, 1))
        for r in got:
            context, prefix = r["text"].split("|", 1)
            assert context == (contexts[int(r["item_id"][1:])] or "all") and prefix == want.get(context, want["all"])
    assert scoring.call_with_anchors(calls.where("false"), parts, echo).collect() == []
    bare = scoring.call_with_anchors(calls.limit(1), scoring.prefix_parts(anchors.where("false"), rubric), echo).first()
    assert bare["text"].endswith("# Scored examples\n\n")


def test_generation(spark, pool, prefixes):
    reply = json.dumps({"plan": {"position": "p"}, "essay": " Two words. ", "notes": {"targetScore": 4}})
    df = spark.createDataFrame([("a", "Only once stated.", 4.0), ("b", "Only once stated.", 2.0), ("c", "Only once stated.", None)], "item_id string, statement string, target double")
    got = {r["item_id"]: r for r in review.generate_batch(df, pool, prefixes, scorer([reply])).collect()}
    assert got["a"]["word_count"] == 2 and got["a"]["plan"]["position"] == "p" and got["a"]["error"] is None
    assert "half point" in got["b"]["error"] and got["c"]["essay"] == "Two words."
    req = scoring.render_write_request(F.lit("s"), F.lit("i"), F.lit("v"), F.array(F.lit("m")), F.lit(4.5), F.lit("argue against"))
    text = spark.range(1).select(req).first()[0]
    assert "earn a 4.5, not higher" in text and "Additional direction: argue against" in text and "1. m" in text


def test_follow_up(spark):
    df = spark.createDataFrame([("a", "ctx", "why?"), ("b", "ctx", "")], "item_id string, context string, question string")

    def echo(batch):
        return scorer(["x"])(batch).assign(text=batch["prefix"] + "|" + batch["request"])
    rows = review.follow_up(df, echo).collect()
    assert len(rows) == 1 and rows[0]["answer"].endswith("ctx|why?")


def test_evaluation_job(spark, pool):
    gold = [(f"g{g}_score{s}", f"Essay {g} {s} speaks.", "Only once stated.", "official", float(s), g * 10 + s) for g in range(2) for s in range(1, 7)]
    gold += [("teacher1", "Essay of a pupil.", "Only once stated.", "teacher_rated", 3.0, 99), ("bad", "Essay.", "unknown", "teacher_rated", 3.0, 100)]
    items_ = spark.createDataFrame(gold, "id string, essay string, statement string, label_source string, true_score double, ordinal int")
    anchors = items_.where("label_source = 'official'").select(
        "ordinal", "id", F.col("true_score").alias("score"), F.regexp_replace("id", r"_score\d$", "").alias("group"), "essay",
        F.lit("st").alias("prompt_statement"), F.lit("in").alias("prompt_instruction"), F.lit("rc").alias("rater_commentary"))
    rubric = spark.createDataFrame([("RUBRIC",)], "rubric string")

    def by_id(batch):
        """Scores what the essay says; fails when the item's own group is in its context."""
        out = scorer([wire(1)])(batch)
        texts = []
        for item, prefix in zip(batch["item_id"], batch["prefix"], strict=True):
            group, _, score = item.partition("_score")
            texts.append("leak" if f"Anchor {group}_" in prefix else wire(float(score or 4)))
        return out.assign(text=texts)

    out = review.evaluate(items_, anchors, pool, rubric, by_id)
    m = {r["cut"]: r for r in out["metrics"].collect()}
    assert m["official"]["n"] == 12 and m["official"]["qwk"] == 1.0 and m["teacher_rated"]["bias"] == 1.0
    assert [(r["pairwise_accuracy"], r["ordered"]) for r in out["ladders"].collect()] == [(1.0, True)] * 2
    assert [r["item_id"] for r in out["failures"].collect()] == ["bad"]
    assert out["usage"].first()["cache_hit_rate"] == pytest.approx(8500 / 17500)
    assert review.evaluate(items_, anchors, pool, rubric, by_id, limit=5)["predictions"].count() <= 5


def test_prompt_spread_with_anchored(spark, pool):
    anchored = spark.createDataFrame([("anchored_x", "Last.", "i", "policy", "s", ["a"], True, "x")],
                                     "id string, statement string, instruction string, variant string, variant_summary string, required_moves array<string>, anchored boolean, anchor_group string")
    got = {(r["id"], r["variant"]) for r in spread_prompts(pool, anchored, VARIANTS, 1).collect()}
    # policy is full, the statement used by two_views is gone for the variant that chooses later
    assert got == {("anchored_x", "policy"), ("t1", "two_views")}


def test_packed_prefix_is_the_assembled_one(spark, monkeypatch):
    """Blocks smaller than the anchors, equal ranks, no group, other scripts."""
    monkeypatch.setattr(scoring, "PACKED_PARTS", 3)
    rows = [(i, f"a{i}", float(i % 3), None if i == 7 else f"g{i % 4}", f"essay 中 {i}", "st", "in", "rc") for i in range(20)]
    schema = "ordinal int, id string, score double, group string, essay string, prompt_statement string, prompt_instruction string, rater_commentary string"
    rubric = spark.createDataFrame([("R",)], "rubric string")
    for few in (rows, rows[:1], []):
        parts = scoring.prefix_parts(spark.createDataFrame(few, schema), rubric)
        blocks = [bytes(r["block"]) for r in scoring.packed_parts(parts).orderBy("rank", "ordinal").collect()]
        for withheld in (None, "g0", "g1", "nobody"):
            assert scoring.unpacked_prefix(blocks, withheld) == scoring.assemble_prefix(parts.toPandas(), withheld)


def test_copies_of_the_anchors_are_bounded_by_the_requests(spark):
    calls = spark.range(1000).select(F.col("id").cast("string").alias("item_id"), F.lit("all").alias("context_id"), F.lit("r" * 10).alias("request"))
    assert scoring.call_pieces(calls, 1, 5_000) == 2 and scoring.call_pieces(calls, 1, 1 << 30) == scoring.call_pieces(calls.limit(0), 1, 9) == 1
    assert scoring.call_pieces(calls, 1000, 1, samples=3) == 3


def test_equal_calls_are_made_once(spark):
    """Equal calls stand in one piece, over batches too; calls that differ in one point stay."""
    rows = [("k", "all", "r", 0)] * 300 + [("k", "all", "r", 1), ("l", "all", "r", 0), (None, "all", "r", 0), (None, "all", "r", 0)]
    calls = spark.createDataFrame(rows, "item_id string, context_id string, request string, sample_idx int")
    parts = scoring.prefix_parts(spark.createDataFrame([], "ordinal int, id string, score double, group string, essay string, prompt_statement string, "
                                                       "prompt_instruction string, rater_commentary string"), spark.createDataFrame([("R",)], "rubric string"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = sorted((r["item_id"] or "", r["sample_idx"]) for r in scoring.call_with_anchors(calls, parts, scorer([wire(3)]), piece_calls=1, distinct=True).collect())
        assert got == [("", 0), ("k", 0), ("k", 1), ("l", 0)]
        assert scoring.call_with_anchors(calls, parts, scorer([wire(3)])).count() == len(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


@pytest.mark.parametrize("kept", [False, True])
def test_a_review_leaves_no_table_of_texts(spark, pool, prefixes, tmp_path, monkeypatch, kept):
    """Essays are written beside no later step: what is left holds keys, answers and error rows."""
    from gradeloom import session
    root = tmp_path / "tables"
    monkeypatch.setattr(session, "checkpoint_root", lambda _: str(root))
    essay = "An essay that nothing else says, at some length."
    rows = spark.createDataFrame([("i1", "Only once stated.", essay), ("i2", "Stated twice.", essay), ("i3", "Only once stated.", " ")],
                                 "item_id string, statement string, essay string")
    out = review.review_batch(rows, pool, prefixes, scorer([wire(4)]), ledger=str(tmp_path / "ledger") if kept else None)
    assert {r["item_id"]: (r["consensus"], r["calls"], r["error"] is None) for r in out.collect()} == {
        "i1": (4.0, 1, True), "i2": (None, 0, False), "i3": (0.0, 0, True)}
    left = list(root.iterdir())
    assert left
    for path in left:
        table = spark.read.parquet(str(path))
        texts = [c for c, kind in table.dtypes if kind == "string"]
        assert not any(essay in (r[c] or "") for r in table.select(*texts).collect() for c in texts), path.name


SHORT_ANCHORS = "ordinal int, id string, score double, group string, essay string, prompt_statement string, prompt_instruction string, rater_commentary string"


def test_long_anchors_are_read_from_the_disk_of_the_task(spark, monkeypatch):
    """No scorer gets anchors beyond the limit as one str, and each reads the same text, of any context, in every piece."""
    rows = [(i, f"g{i % 3}_score{i}", float(i % 4), f"g{i % 3}", f"essay \u4e2d {i} " * 50, "st", "in", "rc") for i in range(12)]
    parts = scoring.prefix_parts(spark.createDataFrame(rows, SHORT_ANCHORS), spark.createDataFrame([("R",)], "rubric string"))
    contexts = ["without:g0"] * 30 + ["without:g1", "all", "without:nobody", None]
    calls = spark.createDataFrame([(f"i{i}", c, "r" * 100_000) for i, c in enumerate(contexts)], "item_id string, context_id string, request string")
    whole = parts.toPandas()
    want = {c: scoring.assemble_prefix(whole, None if c == "all" else c[len("without:"):]) for c in {c or "all" for c in contexts}}
    monkeypatch.setattr(scoring, "PACKED_PARTS", 2)
    monkeypatch.setattr(scoring, "WHOLE_CHARS", 1000)

    def echo(batch):
        kinds = {type(p).__name__ for p in batch["prefix"]}
        chunks = max(len(list(p.chunks())) if isinstance(p, scoring.LongText) else 0 for p in batch["prefix"])
        return scorer([wire(3)])(batch).assign(text=batch["context_id"] + "|" + batch["prefix"], refusal=",".join(kinds), input=batch["prefix"].str.len(), output=chunks)
    for piece_calls in (7, 1000):
        got = scoring.call_with_anchors(calls, parts, echo, samples=2, piece_calls=piece_calls).collect()
        assert sorted((r["item_id"], r["sample_idx"]) for r in got) == sorted((f"i{i}", s) for i in range(len(contexts)) for s in (0, 1))
        for r in got:
            context, prefix = r["text"].split("|", 1)
            assert context == (contexts[int(r["item_id"][1:])] or "all") and prefix == want[context]
            assert r["refusal"] == "LongText" and r["input"] == len(prefix) and r["output"] > 3


def test_long_text_is_searched_over_its_seams(spark, monkeypatch):
    monkeypatch.setattr(scoring, "PACKED_PARTS", 1)
    rows = [(i, f"a{i}", 1.0, f"g{i % 2}", f"essay {i}", "st", "in", "rc") for i in range(5)]
    parts = scoring.prefix_parts(spark.createDataFrame(rows, SHORT_ANCHORS), spark.createDataFrame([("R",)], "rubric string"))
    blocks = scoring.BlockFile()
    blocks.extend(bytes(r["block"]) for r in scoring.packed_parts(parts).orderBy("rank", "ordinal").collect())
    for withheld in (None, "g0", "g1"):
        text, whole = scoring.LongText(blocks, withheld), scoring.assemble_prefix(parts.toPandas(), withheld)
        assert len(text) == len(whole) and str(text) == f"{text}" == whole and "x" + text + "y" == f"x{whole}y"
        for size in (1, 9, 40, 300):
            assert all(whole[i:i + size] in text for i in range(len(whole)))
        assert "" in text and "essay 9" not in text and whole + "x" not in text
    assert "essay 0" not in scoring.LongText(blocks, "g0") and "essay 1" in scoring.LongText(blocks, "g0")
    blocks.close()


def test_packed_blocks_are_bounded_by_bytes():
    cuts = lambda sizes: list(scoring._cuts(sizes))
    most = scoring.PACKED_BYTES
    assert cuts([]) == [] and cuts([5, 5]) == [(0, 2)] and cuts([most + 1, 1, most, 1]) == [(0, 1), (1, 1), (2, 1), (3, 1)]
    assert cuts([1] * (2 * scoring.PACKED_PARTS + 1)) == [(0, scoring.PACKED_PARTS), (scoring.PACKED_PARTS, scoring.PACKED_PARTS), (2 * scoring.PACKED_PARTS, 1)]


def test_a_piece_has_few_contexts_and_its_share_of_the_calls(spark):
    sizes = {"all": 600, **{f"without:g{i}": 40 for i in range(10)}}
    calls = spark.createDataFrame([(f"{c}{i}", c) for c, n in sizes.items() for i in range(n)] * 2, "item_id string, context_id string")
    dealt = scoring._dealt(calls, 5)
    got = dealt.groupBy("_piece").agg(F.count("*").alias("n"), F.countDistinct("context_id").alias("contexts")).collect()
    assert {r["_piece"] for r in got} == set(range(5)) and sum(r["contexts"] for r in got) <= len(sizes) + 4
    assert all(300 <= r["n"] <= 500 for r in got)
    assert dealt.groupBy("item_id", "context_id").agg(F.countDistinct("_piece").alias("n")).where("n > 1").isEmpty()
    assert scoring._dealt(calls.limit(0), 1).count() == 0


def test_a_response_is_parsed_once(spark):
    """The parts of a review come from one parse of its text, and are what each part's own parse gives."""
    texts = [wire(3), "no json", "{", "null", "[]", None, "", '{"holisticScore":"x"}', '{"holisticScore":3}', '{"holisticScore":3,"axisAssessments":5}',
             wire(2).replace("}", ',"suggestions":"none"}', 1), '{"holisticScore":3,"axisAssessments":{"position":{"score":1}}}']
    df = spark.createDataFrame([(i, t, "no" if i == 0 else None) for i, t in enumerate([wire(1), *texts])], "i int, text string, refusal string")
    once = X.computed_once(X.computed_once(df, _wire=scoring.review_wire()), p=scoring.parse_review(wire="_wire"))
    plan = once.select("i", "p.review", "p.error")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    got, want = ({r["i"]: r["p"] for r in d.collect()} for d in (once, df.select("i", scoring.parse_review().alias("p"))))
    assert got == want and got[0]["error"] == "scorer declined: no" and got[1]["error"] is None


def test_a_ledger_holds_answers_to_long_anchors(spark, tmp_path, monkeypatch):
    """Open calls meet their long prefix; a second run finds the answers and asks nobody."""
    monkeypatch.setattr(scoring, "WHOLE_CHARS", 100)
    rows = [(i, f"a{i}", float(i), f"g{i % 2}", f"essay {i} " * 50, "st", "in", "rc") for i in range(4)]
    parts = scoring.prefix_parts(spark.createDataFrame(rows, SHORT_ANCHORS), spark.createDataFrame([("R",)], "rubric string"))
    whole = parts.toPandas()
    want = {c: len(scoring.assemble_prefix(whole, g)) for c, g in (("all", None), ("without:g0", "g0"), ("without:g1", "g1"))}
    calls = spark.createDataFrame([(f"i{i}", c, f"r{i // 2}") for i, c in enumerate(["all", "all", "without:g0", "without:g1"] * 3)],
                                  "item_id string, context_id string, request string")

    def long(batch):
        assert all(isinstance(p, scoring.LongText) for p in batch["prefix"])
        return scorer([wire(3)])(batch).assign(text=batch["context_id"], input=batch["prefix"].str.len())

    def never(batch):
        raise AssertionError("asked again")
    for ask in (long, never):
        got = scoring.call_once(calls, parts, ask, str(tmp_path / "ledger")).collect()
        assert len(got) == 12 and all(r["input"] == want[r["text"]] and r["refusal"] is None for r in got)


def test_evaluation_against_long_anchors(spark, pool, monkeypatch):
    """Leave-group-out holds where the anchors are too long for one str."""
    monkeypatch.setattr(scoring, "WHOLE_CHARS", 100)
    rows = [(f"g{g}_score{s}", f"Essay {g} {s} speaks.", "Only once stated.", "official", float(s), g * 10 + s) for g in range(2) for s in range(1, 4)]
    gold = spark.createDataFrame(rows, "id string, essay string, statement string, label_source string, true_score double, ordinal int")
    anchors = gold.select("ordinal", "id", F.col("true_score").alias("score"), F.regexp_replace("id", r"_score\d$", "").alias("group"), "essay",
                          F.lit("st").alias("prompt_statement"), F.lit("in").alias("prompt_instruction"), F.lit("rc").alias("rater_commentary"))

    def by_id(batch):
        texts = []
        for item, prefix in zip(batch["item_id"], batch["prefix"], strict=True):
            group, _, score = item.partition("_score")
            other = "g1" if group == "g0" else "g0"
            fine = isinstance(prefix, scoring.LongText) and f"Anchor {group}_" not in prefix and f"Anchor {other}_score3" in prefix
            texts.append(wire(float(score)) if fine else "leak")
        return scorer([wire(1)])(batch).assign(text=texts)
    out = review.evaluate(gold, anchors, pool, spark.createDataFrame([("RUBRIC",)], "rubric string"), by_id)
    assert {r["cut"]: (r["n"], r["qwk"]) for r in out["metrics"].collect()}["official"] == (6, 1.0)
