"""Ordered logic over conversations."""

from pyspark.sql import functions as F

from gradeloom.catalog.base import query, wc
from gradeloom.operators import segments
from gradeloom.operators import threads as T
from gradeloom.sources import adapters as A

_MARK = r"(?:[Tt]he|[Ll]es|[Dd]er|[Dd]e) "


@query("w02_marker_segments", rf"""
WITH m AS (SELECT doc_id AS doc, regexp_extract_all(text, '{_MARK}') AS marks, string_split(regexp_replace(text, '{_MARK}', chr(1), 'g'), chr(1)) AS bodies FROM documents),
s AS (SELECT doc, unnest(range(1, len(marks) + 1)) AS seg_no, marks, bodies FROM m)
SELECT doc, seg_no::INTEGER AS seg_no, marks[seg_no] AS marker, md5(bodies[seg_no + 1]) AS body_md5 FROM s""")
def marker_segments(spark, sf):
    d = A.table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")
    return segments.segment(d, _MARK).select("doc", "seg_no", "marker", F.md5("body").alias("body_md5"))


@query("w03_section_records", rf"""
WITH b AS (SELECT conv_id AS doc, turn AS pos, CASE role WHEN 'system' THEN 'section' WHEN 'user' THEN 'essay' ELSE 'analysis' END AS kind, text FROM conversations),
c AS (SELECT *, count(*) FILTER (WHERE kind = 'analysis') OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS grp FROM b),
p AS (SELECT doc, grp, arg_max(text, pos) AS essay FROM c WHERE kind = 'essay' GROUP BY 1, 2),
s AS (SELECT a.doc, a.pos, a.text AS analysis, p.essay, (SELECT arg_max(text, pos) FROM b x WHERE x.doc = a.doc AND x.kind = 'section' AND x.pos < a.pos) AS section
  FROM c a JOIN p ON p.doc = a.doc AND p.grp = a.grp WHERE a.kind = 'analysis' AND p.essay <> '' AND {wc('p.essay')} >= 20)
SELECT doc, pos, md5(essay) AS essay_md5, md5(section) AS section_md5, md5(analysis) AS analysis_md5, row_number() OVER (PARTITION BY doc ORDER BY pos) AS n FROM s""")
def section_records(spark, sf):
    r = segments.section_records(A.section_blocks(spark, sf), min_words=20)
    return r.select("doc", "pos", F.md5("essay").alias("essay_md5"), F.md5("section").alias("section_md5"),
                    F.md5("analysis").alias("analysis_md5"), "n")


@query("w09_first_scored_reply", r"""
WITH o AS (SELECT conv_id, min(turn) AS open_pos FROM conversations WHERE role = 'user' GROUP BY 1),
r AS (SELECT c.conv_id, c.turn, length(c.text) % 7 AS v, regexp_matches(c.text, ' (les|der|in) ') AS machine FROM conversations c JOIN o USING (conv_id) WHERE c.turn > o.open_pos AND regexp_matches(c.text, ' (de|the) '))
SELECT conv_id AS thread_id, arg_min(v::DOUBLE, turn) AS score, CASE WHEN arg_min(machine, turn) THEN 'estimated' ELSE 'third_party_rated' END AS score_type, min(turn) AS pos FROM r GROUP BY 1""")
def first_scored_reply(spark, sf):
    """Replies that use a chosen word get a score written in front."""
    _, replies = A.openings_and_replies(A.thread_posts(spark, sf))
    score = (F.length("body") % 7).cast("string")
    marked = replies.withColumn("body", F.when(F.col("body").rlike(" (de|the) "), F.concat(score, F.lit("/6 overall. "), F.col("body"))).otherwise(F.col("body")))
    return T.first_scored_reply(marked, machine=" (les|der|in) ").select("thread_id", "score", "score_type", "pos")


@query("w10_first_author", "SELECT conv_id AS thread_id, arg_min(role, turn) AS author FROM conversations WHERE role NOT IN ('system', 'assistant') GROUP BY 1")
def first_author(spark, sf):
    return T.first_human_author(A.thread_posts(spark, sf), ["system", "assistant"])

