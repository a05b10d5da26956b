import json

import pytest
from pyspark.sql import functions as F

from gradeloom import schema as S
from gradeloom.operators import segments, stats
from gradeloom.operators.labels import label
from gradeloom.plans import exemplars, knowledge, validate
from gradeloom.sources import adapters as A
from gradeloom.sources import readers, writers
from gradeloom.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_stages_in_file_order(spark, tmp_path):
    for name, ids in (("b", ["b0", "b1"]), ("a", ["a0", "a1", "a2"])):
        recs = [{"essay_id": i, "essay_text": "t", "score": "" if i == "a0" else "4.5", "notes": ""} for i in ids]
        (tmp_path / f"stage_{name}.json").write_text(json.dumps(recs))
    df = readers.stages(spark, str(tmp_path)).orderBy("ordinal")
    rows = df.collect()
    assert [r["essay_id"] for r in rows] == ["a0", "a1", "a2", "b0", "b1"]
    assert rows[0]["score"] is None and rows[1]["score"] == 4.5 and rows[0]["notes"] is None
    assert readers.stage(spark, str(tmp_path / "stage_none.json")).count() == 0
    assert readers.stage(spark, str(tmp_path / "stage_a.json")).count() == 3


def test_csv_with_bom_quotes_and_odd_rows(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_bytes('﻿id,text,score\n1,"line one\nline ""two"", end",4\n2,short\n3,a,5,extra\n4,plain,\n'.encode())
    rows = readers.corpus_csv(spark, str(path)).orderBy("id").collect()
    assert [r["id"] for r in rows] == ["1", "4"]
    assert rows[0]["text"] == 'line one\nline "two", end' and rows[1]["score"] is None


def test_jsonl_modes(spark, tmp_path):
    posts = tmp_path / "p.jsonl"
    posts.write_text('{"id":"a","created_utc":1}\nnot json\n')
    with pytest.raises(Exception):  # noqa: B017
        readers.posts(spark, str(posts)).collect()
    comments = tmp_path / "c.jsonl"
    comments.write_text('{"link":"a","comments":[{"author":"x","body":"b","score":1,"created_utc":2}]}\nnot json\n')
    assert readers.comment_threads(spark, str(comments)).count() == 1


def test_side_files(spark, tmp_path):
    (tmp_path / "d.txt").write_text("12:20150102, 13:2015,14:20200909,12:20160102\n")
    got = {r["tid"]: r["iso_date"] for r in readers.side_dates(spark, str(tmp_path / "d.txt")).collect()}
    assert got == {"12": "2016-01-02", "14": "2020-09-09"}
    (tmp_path / "u.tsv").write_text("http://a/b\t20200101000000\n")
    assert readers.url_list(spark, str(tmp_path / "u.tsv")).first()["ts"] == "20200101000000"
    urls = spark.createDataFrame([(f"u{i}",) for i in range(50)], "url string")
    first = [r[0] for r in readers.shuffled_prefix(urls, "url", 10).collect()]
    assert first == [r[0] for r in readers.shuffled_prefix(urls, "url", 20).collect()][:10] != sorted(first)


def kb_folder(tmp_path):
    axes = [{"id": a, "name": a, "note": "n"} for a in S.AXES]
    level = lambda s, ax: {"score": s, "summary": f"Summary of {s}", "criteria": [
        {"axis": a, "descriptor": f"Descriptor of {a} at {s} is long enough"} for a in ax]}
    levels = [level(s, S.AXES) for s in (6, 5, 4, 3, 2)] + [level(1, knowledge.AXES_AT_1), level(0, [])]
    anchors = [{"id": f"g{g}_score{s}", "score": float(s), "prompt_statement": f"Statement {g} long enough to count",
                "prompt_instruction": "Write a response in which you discuss the extent to which you agree or disagree with the statement",
                "essay": f"Essay {g} {s} " + "word " * (10 * s), "rater_commentary": "comment " * 90, "source_pdf": "p"}
               for g in range(3) for s in range(6, 0, -1)]
    topics = [{"id": f"t{i}", "statement": f"Topic number {i} " + "x" * 50, "instruction": "Write a response in which you agree or disagree with the statement",
               "variant": "statement", "variant_summary": "s", "required_moves": ["a", "b", "c"]} for i in range(3)]
    docs = {"rubric.json": {"axes": axes, "levels": levels, "source": "s", "note": "n"}, "anchors.json": {"anchors": anchors, "prompts": []},
            "prompts_issue.json": {"topics": topics, "variant_counts": {"statement": 3}},
            "style_exemplars.json": {"exemplars": [{"anchor_id": "g0_score6", "score": 6.0, "role": "target"}], "contrasts": [{"anchor_id": "nope", "score": 3.0, "role": "contrast"}],
                                     "official_length_by_score": {"provenance": "measured", "bands": []}, "human_corpus": {"basis": "b"}, "anti_patterns": {"provenance": "authored"}}}
    for name, doc in docs.items():
        (tmp_path / name).write_text(json.dumps(doc))
    return str(tmp_path)


def test_knowledge_base_and_checks(spark, tmp_path):
    kb = readers.knowledge_base(spark, kb_folder(tmp_path))
    assert kb["criteria"].where("axis is not null").count() == 29 and kb["anchors"].count() == 18
    assert validate.validate_rubric(kb["criteria"], kb["axes"]).count() == 0
    assert validate.validate_anchors(kb["anchors"]).count() == 0
    leaked = kb["anchors"].withColumn("essay", F.when(F.col("id") == "g0_score6", F.concat("essay", F.lit(" "), "rater_commentary")).otherwise(F.col("essay")))
    assert [(r["rule_id"], r["key"]) for r in validate.validate_anchors(leaked).collect()] == [("commentary_leak", "g0_score6")]
    wrong = {(r["rule_id"], r["key"]) for r in validate.validate_topics(kb["topics"], {"statement": 4}).collect()}
    assert wrong == {("topics_per_variant", "statement")}
    pairs = kb["style"].select(F.explode(F.concat("exemplars", "contrasts")).alias("e")).select("e.*")
    assert [r["key"] for r in validate.validate_exemplars(pairs, kb["anchors"]).collect()] == ["nope"]
    assert [(r["rule_id"], r["key"]) for r in validate.validate_style(kb["style"]).collect()] == [("provenance", "human_corpus")]


def test_evaluation_runs_roundtrip(spark, tmp_path):
    run = {"provider": "p", "model": "m", "predictions": [{"id": "a", "trueScore": 3, "predictedScore": 3.5, "labelSource": "x", "samples": [3.5]}]}
    (tmp_path / "r.json").write_text(json.dumps(run))
    r = readers.evaluation_runs(spark, str(tmp_path / "*.json")).first()
    assert (r["run_id"], r["predicted_score"], r["samples"]) == ("r.json", 3.5, [3.5])


def test_sinks(spark, tmp_path):
    e = label(A.essays(spark, SF))
    path = writers.write_stage(e.select("essay_id"), str(tmp_path), "x", "parquet")
    assert spark.read.parquet(path).count() == e.count()
    writers.write_document(spark.createDataFrame([(1, ["a"])], "n int, l array<string>"), str(tmp_path / "doc"))
    assert spark.read.json(str(tmp_path / "doc")).first()["l"] == ["a"]
    for run_id in ("r1", "r2"):
        writers.append_run({"metrics": spark.createDataFrame([(1,)], "n int")}, str(tmp_path / "runs"), run_id)
    assert spark.read.parquet(str(tmp_path / "runs/metrics")).count() == 2


def test_document_parts_join_up(spark):
    pages = [("d", i, f"page {i} MARK{i} body" if i % 3 == 0 else f"more {i}") for i in range(20)]
    df = spark.createDataFrame(pages, "doc string, page_no int, text string")
    whole = segments.segment(segments.assemble_documents(df), r"MARK\d+")
    parts = segments.segment(segments.assemble_documents(df, part_pages=4), r"MARK\d+")
    flat = lambda d: {m: " ".join(b.split()) for m, b in (
        (r["marker"], r["b"]) for r in d.groupBy("marker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "seg_no", "body"))), lambda s: s.body), " ").alias("b")).collect())}
    assert flat(whole) == flat(parts) and len(flat(whole)) == 7


def test_extract_rubric_anchors_topics(spark):
    guide = (
        "Intro Scoring Guide Score 6 A 6 response exhibits the following characteristics: 1. first text 2. second text 3. third 4. fourth 5. fifth "
        "Score 1 A 1 has the following characteristics: 1. a 2. b 3. c 4. d Score 0 Off topic. Sample Responses with Reader")
    docs = spark.createDataFrame([("d", guide)], "doc string, text string")
    rows = knowledge.extract_rubric(docs).orderBy(F.desc("score"), "axis_no").collect()
    assert [(r["score"], r["axis"], r["descriptor"]) for r in rows[:2]] == [(6, "position", "first text"), (6, "development", "second text")]
    assert [r["axis"] for r in rows if r["score"] == 1] == knowledge.AXES_AT_1 and [r["axis"] for r in rows if r["score"] == 0] == [None]
    booklet = (
        "Sample Topic: People rely on tools. Discuss the extent to which you agree. GRE® Scoring Guide "
        "The following sample response received a score of 6: Essay six.\n- 4 -\nmore. Comments on sample essay receiving score of 6: Good work. "
        "The following sample response received a score of 5: Essay five. Comments on sample essay receiving score of 5: Fine. Copyright © 2010 by ETS. x")
    a = knowledge.extract_anchors(spark.createDataFrame([("b", booklet)], "doc string, text string"), prompt=r"Sample Topic: (.*?) GRE. Scoring Guide").orderBy("score").collect()
    assert [(r["score"], r["essay"], r["commentary"]) for r in a] == [(5, "Essay five.", "Fine."), (6, "Essay six. more.", "Good work.")]
    assert a[0]["statement"] == "People rely on tools." and a[0]["id"] == "b_score5"
    pool = (
        "front as it appears in the actual test. First topic. Write a response in which you say X and explain how these considerations shape your position. "
        "12 Second topic. Write a response in which you address both of the views presented.")
    t = knowledge.extract_topics(spark.createDataFrame([("p", pool)], "doc string, text string")).orderBy("topic_no").collect()
    assert [(r["statement"], r["variant"]) for r in t] == [("First topic.", "statement"), ("Second topic.", "two_views")]
    assert knowledge.rubric_differences(knowledge.extract_rubric(docs), knowledge.extract_rubric(docs)).count() == 0


def test_exemplars(spark, tmp_path):
    kb = readers.knowledge_base(spark, kb_folder(tmp_path))
    out = exemplars.build_exemplars(A.essays(spark, SF), kb["anchors"])
    assert out["roles"].where("role = 'target'").count() == 6 and out["roles"].where("role = 'contrast'").count() == 6
    band = {r["score"]: r for r in out["length_bands"].collect()}
    assert band[6]["n"] == 3 and band[6]["median_words"] == 63 and band[6]["word_counts"] == "63x3"
    assert out["word_count"].first()["p10"] <= out["word_count"].first()["median"]
    nums = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "x int")
    assert stats.percentiles(nums, "x").first()["median"] == 2  # 2.5 rounds half-even


def test_stream_resumes_without_repeats(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    one = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:01:00"), (1, "2024-01-01 00:02:00")], "id int, ts string")
    one.withColumn("ts", F.col("ts").cast("timestamp")).write.json(src)
    schema = "id int, ts timestamp"
    from pyspark.sql.types import IntegerType, StructField, StructType, TimestampType
    st = StructType([StructField("id", IntegerType()), StructField("ts", TimestampType())])
    for _ in range(2):
        jobs.run_available(jobs.harvest(jobs.file_stream(spark, src, st, "json")), out, ckpt)
    more = spark.createDataFrame([(2, "2024-01-02 00:00:00"), (3, "2024-01-02 00:00:00")], "id int, ts string")
    more.withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").json(src)
    jobs.run_available(jobs.harvest(jobs.file_stream(spark, src, st, "json")), out, ckpt)
    assert sorted(r["id"] for r in spark.read.schema(schema).parquet(out).collect()) == [1, 2, 3]


def test_ceiling(spark):
    rows = [("review", "ip", f"2024-01-01 00:00:{i:02d}") for i in range(15)] + [("signals", "ip", f"2024-01-01 00:00:{i:02d}") for i in range(18)]
    log = spark.createDataFrame(rows, "endpoint string, client string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = jobs.ceiling_breaches(log, {"review": jobs.PAID_LIMIT}).collect()
    assert [(r["endpoint"], r["calls"], r["blocked"]) for r in got] == [("review", 15, 12)]


def test_stage_round_trip(spark, tmp_path):
    rows = [(f"e{i}", "text", 4.5) for i in range(5)]
    e = spark.createDataFrame(rows, "essay_id string, essay_text string, score double").repartition(3)
    (tmp_path / "stage_a.json").write_text(json.dumps([{"essay_id": "first", "score": "3.5"}]))
    lines, table = (writers.write_stage(e, str(tmp_path), n, f) for n, f in (("b", "json"), ("c c", "parquet")))
    for path in (lines, table):
        assert sorted((r["essay_id"], r["score"]) for r in readers.stage(spark, path).collect()) == [(r[0], r[2]) for r in rows]
    every = readers.stages(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert len(every) == 11 and every[0]["essay_id"] == "first" and len({r["ordinal"] for r in every}) == 11
