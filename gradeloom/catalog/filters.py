"""Filters."""

from pyspark.sql import functions as F

from gradeloom.catalog.base import ANCHORS, ESSAYS, LABELLED, POOL, REASON, TELLS, TELLS_SQL, query, squeeze, strip
from gradeloom.operators import gold, quality, testsets
from gradeloom.operators.labels import label
from gradeloom.plans import exemplars
from gradeloom.sources import adapters as A


@query("f01_quality_filter", f"""WITH {ESSAYS}, r AS (SELECT *, {REASON} AS drop_reason FROM essays)
SELECT essay_id, word_count, drop_reason FROM r""")
def quality_filter(spark, sf):
    return quality.quality_reasons(A.essays(spark, sf)).select("essay_id", "word_count", "drop_reason")


@query("f01_kept_records", f"""WITH {ESSAYS}, r AS (SELECT *, {REASON} AS drop_reason FROM essays)
SELECT essay_id, CASE WHEN regexp_matches(essay_text, '{TELLS_SQL}') THEN 'uncertain' ELSE human_authenticity END AS human_authenticity,
  regexp_matches(essay_text, '{TELLS_SQL}') AS flagged_generated FROM r WHERE drop_reason IS NULL""")
def kept_records(spark, sf):
    return quality.quality_filter(A.essays(spark, sf), TELLS).select("essay_id", "human_authenticity", "flagged_generated")


_FLOOR = "CASE WHEN source_name IN ('src0', 'src5') THEN 120 WHEN source_name = 'src7' THEN 50 WHEN source_name IN ('src9', 'src11') THEN 200 END"


@query("f02_source_floors", f"WITH {ESSAYS} SELECT essay_id, word_count FROM essays WHERE coalesce(word_count >= ({_FLOOR}), true)")
def source_floors(spark, sf):
    floors = spark.createDataFrame(
        [("src0", 120), ("src5", 120), ("src7", 50), ("src9", 200), ("src11", 200)], "source_name string, min_words int")
    return quality.above_source_floor(A.essays(spark, sf), floors).select("essay_id", "word_count")


_DENY = r"(?i)^the |license|ntt"


@query("f03_title_deny", rf"""SELECT coalesce(CASE WHEN regexp_matches(text, '{_DENY}') THEN 'guide' WHEN length(text) < 60 THEN 'no_body' END, 'kept') AS reason,
  count(*) AS n FROM documents GROUP BY 1""")
def title_deny(spark, sf):
    """Documents stand for titles; very short ones count as threads without a body."""
    t = F.col("text")
    reason = quality.title_reason(t, F.when(F.length(t) >= 60, t), _DENY)
    return A.table(spark, sf, "documents").groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("f04_usable_posts", r"""SELECT doc_id FROM documents WHERE text NOT IN ('[removed]', '[deleted]', '')
  AND regexp_matches(source || ' ' || text, '(?i) (the|les) ')""")
def usable_posts(spark, sf):
    d = A.table(spark, sf, "documents")
    return d.where(quality.usable_post(F.col("source"), F.col("text"), r"(?i) (the|les) ")).select("doc_id")


_OPENER = "The |And |Of "
_SPLIT = f"""sp AS (SELECT *, regexp_extract(prompt_text, '(?s)(?:{_OPENER}).*$', 0) AS found FROM labelled),
st AS (SELECT *, {strip("CASE WHEN found = '' THEN prompt_text ELSE left(prompt_text, length(prompt_text) - length(found)) END")} AS statement,
  nullif({strip(squeeze('found'))}, '') AS instruction FROM sp)"""


@query("f05_gold_eligible", f"""WITH {LABELLED}, {_SPLIT}
SELECT essay_id AS id, statement, instruction, score AS true_score FROM st
WHERE subtype = 'A2_teacher_rated' AND essay_type = 'argument' AND essay_text <> '' AND score IS NOT NULL AND length(statement) > 20""")
def gold_eligible(spark, sf):
    return gold.teacher_items(label(A.essays(spark, sf)), opener=_OPENER, task="argument").select("id", "statement", "instruction", "true_score")


@query("f06_confirmed_issue", f"WITH {ESSAYS} SELECT essay_id FROM essays WHERE essay_type = 'issue' AND human_authenticity = 'confirmed'")
def confirmed_issue(spark, sf):
    return exemplars.confirmed_issue(A.essays(spark, sf)).select("essay_id")


@query("f07_scored_issue", f"""WITH {LABELLED} SELECT essay_id AS id, subtype AS label_source, score AS true_score FROM labelled
WHERE essay_type = 'issue' AND score IS NOT NULL AND subtype <> 'B2_unscored'""")
def scored_issue(spark, sf):
    return testsets.review_records(label(A.essays(spark, sf))).select("id", "label_source", "true_score")


@query("f07_out_of_scope", f"""WITH {LABELLED} SELECT essay_id AS id, score AS true_score FROM labelled
WHERE essay_type = 'argument' AND subtype = 'B1_machine_scored' AND score IS NOT NULL""")
def out_of_scope(spark, sf):
    return testsets.out_of_scope(label(A.essays(spark, sf))).select("id", "true_score")


_GOLD = f"""{LABELLED}, {_SPLIT}, {ANCHORS}, gold AS (
  SELECT id, 'official' AS label_source, score AS true_score, false AS held_out, ordinal FROM anchors
  UNION ALL SELECT essay_id, 'teacher_rated', score, true, ordinal FROM st
  WHERE subtype = 'A2_teacher_rated' AND essay_type = 'argument' AND essay_text <> '' AND score IS NOT NULL AND length(statement) > 20)"""


def gold_items(spark, sf):
    return gold.gold_set(A.anchors(spark, sf), label(A.essays(spark, sf)), opener=_OPENER, task="argument")


@query("u02_gold_set", f"WITH {_GOLD} SELECT id, label_source, true_score, held_out FROM gold")
def gold_set(spark, sf):
    return gold_items(spark, sf).select("id", "label_source", "true_score", "held_out")


@query("f08_held_out", f"WITH {_GOLD} SELECT id, true_score FROM gold WHERE held_out")
def held_out(spark, sf):
    return gold_items(spark, sf).where("held_out").select("id", "true_score")


@query("a23_gold_composition", f"WITH {_GOLD} SELECT label_source, true_score, count(*) AS n, count(*) FILTER (WHERE held_out) AS held_out FROM gold GROUP BY 1, 2")
def gold_composition(spark, sf):
    return gold.composition(gold_items(spark, sf))


@query("w05_round_robin", f"""WITH {_GOLD}, r AS (SELECT *, row_number() OVER (PARTITION BY true_score ORDER BY held_out, ordinal) AS rn,
  min(ordinal + CASE WHEN held_out THEN 1000000000000 ELSE 0 END) OVER (PARTITION BY true_score) AS seen FROM gold)
SELECT id, true_score FROM r ORDER BY rn, seen, true_score LIMIT 40""")
def round_robin(spark, sf):
    """A sampling report of 40 items, official ones first within a score."""
    return gold.round_robin(gold_items(spark, sf), 40).select("id", "true_score")


@query("f09_topic_search", f"""WITH {POOL} SELECT id, strpos(lower(statement), 'the th')::INTEGER AS match_start, 6 AS match_length FROM pool
WHERE variant = 'policy' AND contains(lower(statement), 'the th')""")
def topic_search(spark, sf):
    return quality.topic_search(A.pool(spark, sf), " The th ", "policy").select("id", "match_start", "match_length")


@query("f10_lookups", f"WITH {ANCHORS} SELECT id, score FROM anchors WHERE score = 5")
def lookups(spark, sf):
    return A.anchors(spark, sf).where(F.col("score") == 5.0).select("id", "score")


@query("f11_exemplar_roles", f"""WITH {ANCHORS} SELECT id AS anchor_id, score, CASE WHEN score >= 5 THEN 'target' ELSE 'contrast' END AS role
FROM anchors WHERE score >= 5 OR score IN (3, 4)""")
def exemplar_roles(spark, sf):
    return exemplars.exemplar_roles(A.anchors(spark, sf))
