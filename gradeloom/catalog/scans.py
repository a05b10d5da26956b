"""Sources and sinks."""

from pyspark.sql import functions as F

from gradeloom.catalog.base import ESSAYS, LABELLED, PREDS, query
from gradeloom.operators import segments, stats, testsets
from gradeloom.operators.labels import label
from gradeloom.schema import ESSAY
from gradeloom.session import scratch_path
from gradeloom.sources import adapters as A
from gradeloom.sources import readers, writers


@query("s01_stage_union", f"""WITH {ESSAYS}
SELECT 'stage_' || essay_type AS stage, essay_id, ordinal, word_count FROM essays""")
def stage_union(spark, sf):
    e = A.essays(spark, sf)
    parts = [e.where(F.col("essay_type") == t).withColumn("stage", F.lit(f"stage_{t}")) for t in sorted(A.ESSAY_TYPES)]
    return readers.union_stages(*parts).select("stage", "essay_id", "ordinal", "word_count")


_CSV_TEXT = """CASE doc_id % 4 WHEN 0 THEN text || '"' || chr(10) || ',"end' WHEN 1 THEN replace(text, ' ', '""') WHEN 2 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END"""


@query("s03_corpus_csv", f"""SELECT doc_id::VARCHAR AS doc_id, nullif(trim(lang), '') AS lang, nullif(trim(source), '') AS source, md5({_CSV_TEXT}) AS text_md5
FROM documents WHERE doc_id % 17 <> 0 AND doc_id % 19 <> 0 AND trim({_CSV_TEXT}) <> ''""")
def corpus_csv(spark, sf):
    """Documents written as quoted CSV files of two halves, with marks, short and long rows, read back by ranges."""
    folder, doc, text = scratch_path(spark, "csv"), F.col("doc_id"), F.col("text")
    text = (F.when(doc % 4 == 0, F.concat(text, F.lit('"\n,"end'))).when(doc % 4 == 1, F.replace(text, F.lit(" "), F.lit('""')))
            .when(doc % 4 == 2, F.replace(text, F.lit("\n"), F.lit("\r\n"))).otherwise(text))
    whole = [doc, F.col("lang"), F.col("source"), text]
    line = F.when(doc % 17 == 0, writers.csv_line(whole[:3])).when(doc % 19 == 0, writers.csv_line([*whole, F.lit("more")])).otherwise(
        writers.csv_line(whole))
    writers.framed_text(A.table(spark, sf, "documents").withColumn("half", doc % 2), "half", "doc_id", line, folder,
                        F.lit("\ufeffdoc_id,lang,source,text"), file_chars=writers.FILE_CHARS)
    rows = readers.corpus_csv(spark, folder).where("text is not null")
    return rows.select("doc_id", "lang", "source", F.md5("text").alias("text_md5"))


@query("s02_stage_files", f"""WITH {ESSAYS} SELECT essay_id, essay_type, score, CASE WHEN trim(essay_text) <> '' THEN md5(essay_text) END AS text_md5 FROM essays""")
def stage_files(spark, sf):
    """Three stages, as JSON lines and as Parquet, read back as one table with an ordinal of its own for each row."""
    folder, e = scratch_path(spark, "stages"), A.essays(spark, sf)
    for kind, fmt in zip(A.ESSAY_TYPES, ("json", "parquet", "json"), strict=True):
        writers.write_stage(e.where(F.col("essay_type") == kind).select("essay_id", "essay_type", "essay_text", "score"), folder, kind, fmt)
    rows = readers.stages(spark, folder)
    # a repeated ordinal would lose a row here
    one = rows.groupBy("ordinal").agg(F.min(F.struct("essay_id", "essay_type", "score", "essay_text")).alias("r")).select("r.*")
    return one.select("essay_id", "essay_type", "score", F.md5("essay_text").alias("text_md5"))


@query("s05_posts", """SELECT 'p' || doc_id AS id, source AS subreddit, doc_id AS created_utc, md5(text) AS body_md5 FROM documents""")
def posts(spark, sf):
    """Posts as JSON lines."""
    folder, doc = scratch_path(spark, "posts"), F.col("doc_id")
    A.table(spark, sf, "documents").select(
        F.concat(F.lit("p"), doc.cast("string")).alias("id"), F.col("source").alias("subreddit"), F.col("text").alias("selftext"),
        doc.alias("created_utc")).write.json(folder)
    return readers.posts(spark, folder).select("id", "subreddit", "created_utc", F.md5("selftext").alias("body_md5"))


@query("s06_comment_threads", """SELECT conv_id::VARCHAR AS link, count(*) AS comments, md5(string_agg(text, chr(10) ORDER BY turn)) AS bodies_md5,
  sum(turn)::BIGINT AS score FROM conversations GROUP BY 1""")
def comment_threads(spark, sf):
    """Threads as JSON lines between lines that are none."""
    folder = scratch_path(spark, "comments")
    listed = F.array_sort(F.collect_list(F.struct("turn", F.struct(F.col("role").alias("author"), F.col("text").alias("body"), F.col("turn").alias("score")).alias("c"))))
    threads = A.table(spark, sf, "conversations").groupBy("conv_id").agg(listed.alias("l"))
    good = F.to_json(F.struct(F.col("conv_id").cast("string").alias("link"), F.transform("l", lambda x: x["c"]).alias("comments")))
    lines = F.when(F.col("conv_id") % 3 == 0, F.array(good, F.lit("not json"))).otherwise(F.array(good))
    threads.select(F.explode(lines).alias("value")).write.text(folder)
    c = readers.comment_threads(spark, folder)
    return c.select("link", F.size("comments").cast("bigint").alias("comments"), F.md5(F.array_join("comments.body", "\n")).alias("bodies_md5"),
                    F.aggregate("comments", F.lit(0).cast("bigint"), lambda a, x: a + x["score"]).alias("score"))


@query("s08_side_dates", """SELECT doc_id::VARCHAR AS tid, strftime(DATE '2015-01-01' + doc_id::INTEGER, '%Y-%m-%d') AS iso_date FROM documents WHERE doc_id % 5 <> 0""")
def side_dates(spark, sf):
    """Pairs of thread and date, several to a line; every fifth one is cut short and skipped."""
    folder, doc = scratch_path(spark, "dates"), F.col("doc_id")
    day = F.date_format(F.date_add(F.lit("2015-01-01").cast("date"), doc.cast("int")), "yyyyMMdd")
    pair = F.concat_ws(":", doc.cast("string"), F.when(doc % 5 == 0, F.left(day, F.lit(4))).otherwise(day))
    A.table(spark, sf, "documents").groupBy(F.floor(doc / 8)).agg(F.array_join(F.collect_list(pair), ", ").alias("value")).select("value").write.text(folder)
    return readers.side_dates(spark, folder)


@query("s09_url_list", "SELECT url, lpad(page_id::VARCHAR, 14, '2') AS ts FROM pages")
def url_list(spark, sf):
    """Addresses and times of snapshots, parted by tabs."""
    folder = scratch_path(spark, "urls")
    A.table(spark, sf, "pages").select(F.concat_ws("\t", "url", F.lpad(F.col("page_id").cast("string"), 14, "2")).alias("value")).write.text(folder)
    return readers.url_list(spark, folder)


@query("k04_document", """SELECT count(*) AS documents, string_agg(source || ':' || n, ',' ORDER BY source) AS sources, sum(n)::BIGINT AS total
FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)""")
def nested_document(spark, sf):
    """A nested document of one row, written and read back."""
    folder = scratch_path(spark, "document")
    counts = A.table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    writers.write_document(counts.agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("sources")), folder)
    back = spark.read.schema("sources array<struct<source:string,n:bigint>>").json(folder)
    return back.select(
        F.size("sources").cast("bigint").alias("documents"),
        F.array_join(F.transform("sources", lambda s: F.concat_ws(":", s["source"], s["n"].cast("string"))), ",").alias("sources"),
        F.aggregate("sources", F.lit(0).cast("bigint"), lambda a, s: a + s["n"]).alias("total"))


@query("s07_thread_files", """
SELECT conv_id::VARCHAR AS thread, count(*) AS posts, md5(string_agg(text, chr(10) ORDER BY turn)) AS bodies_md5, string_agg(role, ',' ORDER BY turn) AS roles
FROM conversations GROUP BY 1""")
def thread_files(spark, sf):
    """Threads written as array files, read back by ranges."""
    folder = scratch_path(spark, "threads")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    threads = A.table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("p")).select(
        (F.col("conv_id") % 2).alias("half"), F.col("conv_id").alias("o"), F.col("conv_id").cast("string").alias("t"),
        F.transform("p", lambda x: x["text"]).alias("b"), F.transform("p", lambda x: x["role"]).alias("us"))
    writers.write_json_arrays(threads, folder, "half", "o")
    return readers.forum_threads(spark, folder).select(
        F.col("t").alias("thread"), F.size("b").cast("bigint").alias("posts"), F.md5(F.array_join("b", "\n")).alias("bodies_md5"),
        F.array_join("us", ",").alias("roles"))


@query("s14_evaluation_runs", f"""WITH {PREDS}, r AS (SELECT *, row_number() OVER (PARTITION BY ladder ORDER BY ordinal) - 1 AS place FROM preds)
SELECT 'engine "' || ladder || '"' AS model, place::INTEGER AS ordinal, item_id AS id, true_score, predicted_score, label_source, predicted_score AS first_sample FROM r""")
def evaluation_runs(spark, sf):
    """Predictions written as one run file per source, read back by ranges."""
    folder = scratch_path(spark, "runs")
    p = A.predictions(spark, sf).select(
        F.regexp_extract("id", r"^(.*)_score", 1).alias("run"), "ordinal", F.col("item_id").alias("id"), F.col("true_score").alias("trueScore"),
        F.col("predicted_score").alias("predictedScore"), F.col("label_source").alias("labelSource"), "samples")
    head = F.struct(F.lit("p{[").alias("provider"), F.concat(F.lit('engine "'), F.col("run"), F.lit('"')).alias("model"))
    writers.write_json_arrays(p, folder, "run", "ordinal", head, "predictions")
    rows = readers.evaluation_runs(spark, f"{folder}/*/*.txt")
    return rows.select("model", "ordinal", "id", "true_score", "predicted_score", "label_source", F.col("samples")[0].alias("first_sample"))


@query("k06_run_append", f"""WITH {PREDS}, runs AS (SELECT unnest(['a', 'b']) AS run_id, unnest([0.0, 0.5]::DOUBLE[]) AS shift)
SELECT run_id, item_id, true_score, predicted_score + shift AS predicted_score, n FROM preds, runs, (SELECT count(*) AS n FROM preds)""")
def run_append(spark, sf):
    """Two published runs; a third one broke off between its parts and is not seen."""
    folder = scratch_path(spark, "run-table")
    p = A.predictions(spark, sf).select("item_id", "true_score", "predicted_score")
    for run_id, shift in (("a", 0.0), ("b", 0.5)):
        own = p.withColumn("predicted_score", F.col("predicted_score") + shift)
        writers.append_run({"predictions": own, "sizes": own.agg(F.count("*").alias("n"))}, folder, run_id)
    writers.write_run_parts({"predictions": p}, folder, "broken")
    sizes = readers.run_part(spark, folder, "sizes")
    return readers.run_part(spark, folder, "predictions").join(sizes, "run_id").select("run_id", "item_id", "true_score", "predicted_score", "n")


@query("s07_forum_threads", """
WITH o AS (SELECT conv_id, min(turn) AS open_pos, min_by(text, turn) AS body FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT c.conv_id AS thread_id, count(*) AS posts, any_value(md5(o.body)) AS opening_md5,
  count(*) FILTER (WHERE c.turn > o.open_pos) AS replies
FROM conversations c LEFT JOIN o USING (conv_id) GROUP BY 1""")
def forum_threads(spark, sf):
    posts = A.thread_posts(spark, sf)
    opening, replies = A.openings_and_replies(posts)
    n = posts.groupBy("thread_id").agg(F.count("*").alias("posts"))
    r = replies.groupBy("thread_id").agg(F.count("*").alias("replies"))
    return n.join(opening, "thread_id", "left").join(r, "thread_id", "left").select(
        "thread_id", "posts", F.md5("body").alias("opening_md5"), F.coalesce("replies", F.lit(0)).alias("replies"))


@query("s10_ok_pages", "SELECT page_id, url, length(html)::INTEGER AS body_chars FROM pages WHERE page_id % 10 <> 0")
def ok_pages(spark, sf):
    return readers.ok_pages(A.cached_pages(spark, sf)).select("page_id", "url", F.length("body").alias("body_chars"))


@query("s11_id_prefix", f"WITH {ESSAYS} SELECT essay_id, source_name FROM essays WHERE starts_with(essay_id, 'doc_1')")
def id_prefix(spark, sf):
    return readers.rows_with_prefix(A.essays(spark, sf), "essay_id", "doc_1").select("essay_id", "source_name")


@query("s12_document_text", """
SELECT conv_id AS doc, 0 AS part, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1""")
def document_text(spark, sf):
    return segments.assemble_documents(A.table(spark, sf, "conversations"), "conv_id", "turn").withColumnRenamed("conv_id", "doc")


@query("k01_corpus_export", f"WITH {LABELLED} SELECT essay_id, source_name, priority::VARCHAR AS priority, md5(essay_text) AS text_md5, coalesce(score::VARCHAR, '') AS score FROM labelled")
def corpus_export(spark, sf):
    """Write the ordered CSV export, then read it back with the corpus reader."""
    folder = scratch_path(spark, "export")
    writers.write_corpus(label(A.essays(spark, sf)), folder)
    back = readers.corpus_csv(spark, f"{folder}/csv")
    return back.select("essay_id", "source_name", "priority", F.md5("essay_text").alias("text_md5"),
                       F.coalesce("score", F.lit("")).alias("score"))


@query("k03_tier_files", f"""WITH {LABELLED} SELECT essay_id AS id, subtype AS tier, score AS true_score FROM labelled
WHERE essay_type = 'issue' AND score IS NOT NULL AND subtype <> 'B2_unscored'""")
def tier_files(spark, sf):
    """JSONL per trust tier, read back through the partition column."""
    folder = scratch_path(spark, "tiers")
    writers.write_tiers(testsets.review_records(label(A.essays(spark, sf))).select("id", "label_source", "true_score"), folder)
    return spark.read.schema("id string, label_source string, true_score double, tier string").json(folder).select(
        "id", "tier", "true_score")


@query("k05_tier_manifest", f"""WITH {LABELLED}, t AS (
  SELECT subtype, score, count(*) AS n FROM labelled
  WHERE essay_type = 'issue' AND score IS NOT NULL AND subtype <> 'B2_unscored' GROUP BY 1, 2)
SELECT subtype AS label_source, sum(n)::BIGINT AS count, string_agg(score::VARCHAR || ':' || n, ', ' ORDER BY score) AS score_distribution
FROM t GROUP BY 1""")
def tier_manifest(spark, sf):
    records = testsets.review_records(label(A.essays(spark, sf)))
    return stats.tier_manifest(records).select("label_source", "count", "score_distribution")


@query("u01_union_by_name", f"""WITH {ESSAYS}
SELECT 'a' AS origin, essay_id, score FROM essays UNION ALL SELECT 'b', essay_id, NULL FROM essays""")
def union_by_name(spark, sf):
    e = A.essays(spark, sf)
    scored = e.select(F.lit("a").alias("origin"), "essay_id", "score")
    return readers.union_stages(scored, e.select(F.lit("b").alias("origin"), "essay_id"))


@query("x45_record_defaults", f"""WITH {ESSAYS}
SELECT essay_id, score IS NOT NULL AS score_available,
  CASE WHEN score IS NULL THEN coalesce(CASE WHEN score_type IN ('none') THEN NULL ELSE score_type END, 'none') ELSE score_type END AS score_type,
  word_count FROM essays""")
def record_defaults(spark, sf):
    from gradeloom.plans.parsers import make_records
    e = A.essays(spark, sf)
    blank = F.when(F.col("score_type") != "none", F.col("score_type"))
    made = make_records(e, essay_id=F.col("essay_id"), essay_text=F.col("essay_text"), score=F.col("score"), score_type=blank)
    assert {f.name for f in ESSAY.fields} <= set(made.columns)
    return made.select("essay_id", "score_available", "score_type", "word_count")
