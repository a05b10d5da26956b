"""Joins."""

from pyspark.sql import functions as F

from gradeloom.catalog.base import ANCHORS, POOL, PREDS, SIGNAL_RULES, case_rules, query, squeeze, stated, strip
from gradeloom.operators import agreement, checks, dedup, gold, segments
from gradeloom.operators import threads as T
from gradeloom.operators.prompts import resolve_prompts, variant_templates
from gradeloom.plans import knowledge
from gradeloom.sources import adapters as A

# Word patterns that stand for scores in texts without numbers.
GRADE_SQL = r"CASE WHEN regexp_matches(t, ' the of ') THEN 1 WHEN regexp_matches(t, ' and ') THEN 2 WHEN regexp_matches(t, ' les ') THEN 3 END"
GRADES = [(" the of ", 1.0), (" and ", 2.0), (" les ", 3.0)]


def graded_comments(spark, sf):
    """Comments with a digit written in front of each, which the score patterns then read."""
    c = A.comments(spark, sf)
    digit = F.coalesce(*[F.when(F.col("body").rlike(rx), F.lit(str(int(v)))) for rx, v in GRADES])
    return c.withColumn("body", F.when(digit.isNotNull(), F.concat(F.lit("Score: "), digit, F.lit(" because "), F.col("body"))).otherwise(F.col("body")))


_GRADED = f"""c AS (SELECT conv_id AS link, turn AS pos, role AS author, (conv_id * 31 + turn * 7) % 11 AS votes, text AS t FROM conversations),
g AS (SELECT *, ({GRADE_SQL})::DOUBLE AS value FROM c),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY votes DESC, pos) AS rn FROM g WHERE value IS NOT NULL) WHERE rn = 1)"""


@query("w08_best_grader", f"WITH {_GRADED} SELECT link, value, author, votes, pos FROM best")
def best_grader(spark, sf):
    return T.best_grader_comment(graded_comments(spark, sf), patterns=[r"Score: ([0-6]) because"], totals=r"(?!)").drop("context")


@query("j01_community_grade", f"""WITH {_GRADED}, p AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN (doc_id % 13)::DOUBLE / 2 END AS score FROM documents)
SELECT id, coalesce(score, value) AS score, CASE WHEN score IS NOT NULL THEN 'self_reported' WHEN value IS NOT NULL THEN 'third_party_rated' ELSE 'none' END AS score_type
FROM p LEFT JOIN best ON best.link = p.id""")
def community_grade(spark, sf):
    own = F.when(F.col("doc_id") % 4 == 0, (F.col("doc_id") % 13) / 2.0)
    posts = A.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), own.alias("score"), F.when(
        own.isNotNull(), "self_reported").alias("score_type"))
    graded = T.best_grader_comment(graded_comments(spark, sf), patterns=[r"Score: ([0-6]) because"], totals=r"(?!)")
    return T.fill_from_comments(posts, graded).select("id", "score", "score_type")


@query("j02_thread_dates", """
WITH t AS (SELECT DISTINCT conv_id AS tid, CASE WHEN conv_id % 2 = 0 THEN '2020-01-01' END AS parsed FROM conversations),
d AS (SELECT doc_id AS tid, strftime(DATE '2015-01-01' + doc_id::INTEGER, '%Y-%m-%d') AS side FROM documents WHERE source IN ('src0', 'src1', 'src2', 'src3'))
SELECT tid, coalesce(side, parsed) AS publication_date FROM t LEFT JOIN d USING (tid)""")
def thread_dates(spark, sf):
    t = A.table(spark, sf, "conversations").select(F.col("conv_id").alias("tid")).distinct().withColumn(
        "parsed_date", F.when(F.col("tid") % 2 == 0, "2020-01-01"))
    d = A.table(spark, sf, "documents").where(F.col("source").isin("src0", "src1", "src2", "src3")).select(
        F.col("doc_id").alias("tid"), F.date_add(F.lit("2015-01-01").cast("date"), F.col("doc_id").cast("int")).cast("string").alias("iso_date"))
    return T.with_thread_dates(t, d).select("tid", "publication_date")


_RES = f"""{POOL}, req AS (
  SELECT doc_id AS id, b.text AS statement, CASE WHEN doc_id % 5 = 0 THEN d.text END AS instruction,
    CASE WHEN doc_id % 7 = 0 THEN 'policy' END AS given FROM documents d {stated(1)}),
tmpl AS (SELECT variant, min_by(instruction, ordinal) AS ti FROM pool GROUP BY 1),
byst AS (SELECT {strip(squeeze('lower(statement)'))} AS k, count(DISTINCT variant) AS hits, any_value(variant) AS v, any_value(instruction) AS si FROM pool GROUP BY 1),
st AS (SELECT *, coalesce(given, {case_rules('instruction', SIGNAL_RULES)}) AS sv, {strip(squeeze("lower(coalesce(statement, ''))"))} AS k FROM req)"""


@query("j03_resolve_prompt", f"""WITH {_RES}
SELECT id, CASE WHEN sv IS NOT NULL THEN sv WHEN hits = 1 THEN v END AS variant,
  md5(CASE WHEN sv IS NOT NULL THEN coalesce(nullif({strip("coalesce(st.instruction, '')")}, ''), ti) WHEN hits = 1 THEN si END) AS instruction_md5,
  CASE WHEN sv IS NOT NULL OR hits = 1 THEN 'resolved' WHEN hits > 1 THEN 'ambiguous' ELSE 'unknown' END AS outcome
FROM st LEFT JOIN tmpl ON tmpl.variant = st.sv LEFT JOIN byst USING (k)""")
def resolve_prompt(spark, sf):
    d, doc = A.table(spark, sf, "documents"), F.col("doc_id")
    req = A.with_statement(d, spark, sf, idle=1).select(
        doc.alias("id"), "statement", F.when(doc % 5 == 0, F.col("text")).alias("instruction"), F.when(doc % 7 == 0, "policy").alias("variant"))
    out = resolve_prompts(req, A.pool(spark, sf), SIGNAL_RULES)
    e = F.col("resolution_error")
    outcome = F.when(e.isNull(), "resolved").when(F.startswith(e, F.lit("statement is in the pool")), "ambiguous").otherwise("unknown")
    return out.select("id", "variant", F.md5("resolved_instruction").alias("instruction_md5"), outcome.alias("outcome"))


@query("j04_variant_template", f"""WITH {POOL} SELECT variant, min_by(id, ordinal) AS first_id, max_by(id, ordinal) AS last_id FROM pool GROUP BY 1""")
def variant_template(spark, sf):
    p = A.pool(spark, sf)
    p = p.withColumn("instruction", F.col("id"))
    first, last = variant_templates(p), variant_templates(p, "last")
    return first.select("variant", F.col("instruction").alias("first_id")).join(
        last.select("variant", F.col("instruction").alias("last_id")), "variant")


@query("j05_ladder_predictions", f"""WITH {PREDS}, n AS (SELECT ladder FROM preds GROUP BY 1 HAVING count(*) >= 4)
SELECT item_id, ladder, true_score, predicted_score FROM preds JOIN n USING (ladder)""")
def ladder_predictions(spark, sf):
    items = agreement.with_ladder(A.predictions(spark, sf))
    preds = A.predictions(spark, sf).select("item_id", "true_score", "predicted_score")
    return items.select("item_id", "ladder").join(preds, "item_id")


@query("j06_leave_group_out", f"""WITH {ANCHORS}, g AS (SELECT grp, count(*) AS own, sum(score) AS own_score FROM anchors GROUP BY 1),
t AS (SELECT count(*) AS n, sum(score) AS s FROM anchors)
SELECT d.doc_id AS id, d.source AS "group", CASE WHEN own > 0 THEN 'without:' || d.source ELSE 'all' END AS context_id,
  t.n - coalesce(own, 0) AS context_anchors, coalesce(own, 0) AS withheld_anchors, t.s - coalesce(own_score, 0) AS context_score_sum
FROM documents d LEFT JOIN g ON g.grp = d.source, t""")
def leave_group_out(spark, sf):
    items = A.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("group"))
    return gold.leave_group_out(items, A.anchors(spark, sf))


@query("j07_unseen", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def unseen(spark, sf):
    seen = A.table(spark, sf, "labels").where("quality = 1")
    return dedup.unseen(A.table(spark, sf, "documents").select("doc_id"), seen, "doc_id")


@query("j10_foreign_key", "SELECT 'label_doc' AS rule_id, doc_id::VARCHAR AS key FROM labels WHERE doc_id NOT IN (SELECT conv_id FROM conversations)")
def foreign_key(spark, sf):
    out = checks.foreign_key(A.table(spark, sf, "labels"), "doc_id", A.table(spark, sf, "conversations"), "conv_id", "label_doc")
    return out.select("rule_id", "key")


_X = """a AS (SELECT doc_id AS score, md5(text) AS summary, source AS axis, lang AS descriptor FROM documents WHERE source <> 'src1'),
b AS (SELECT doc_id, md5(text), source, CASE WHEN doc_id % 50 = 2 THEN 'xx' ELSE lang END FROM documents WHERE source <> 'src2')"""


@query("j11_cross_check", f"""WITH {_X} SELECT score, descriptor, 'first' AS only_in FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
UNION ALL SELECT score, descriptor, 'second' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) AS q(score, summary, axis, descriptor)""")
def cross_check(spark, sf):
    d = A.table(spark, sf, "documents").select(
        F.col("doc_id").alias("score"), F.md5("text").alias("summary"), F.col("source").alias("axis"), F.col("lang").alias("descriptor"))
    b = d.where("axis <> 'src2'").withColumn("descriptor", F.when(F.col("score") % 50 == 2, "xx").otherwise(F.col("descriptor")))
    return knowledge.rubric_differences(d.where("axis <> 'src1'"), b).select("score", "descriptor", "only_in")


@query("u05_difference", f"WITH {_X} SELECT score, descriptor FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)")
def difference(spark, sf):
    return cross_check(spark, sf).where("only_in = 'first'").select("score", "descriptor")


@query("j12_essay_commentary", """
SELECT conv_id AS doc, turn // 2 AS score, min_by(md5(text), turn) FILTER (WHERE role = 'user') AS essay_md5,
  coalesce(max_by(md5(text), turn) FILTER (WHERE role <> 'user'), md5('')) AS commentary_md5
FROM conversations GROUP BY 1, 2 HAVING count(*) FILTER (WHERE role = 'user') > 0""")
def essay_commentary(spark, sf):
    c = A.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc"), F.floor(F.col("turn") / 2).alias("score"), F.col("turn").alias("seg_no"),
        F.when(F.col("role") == "user", "essay").otherwise("commentary").alias("kind"), F.col("text").alias("body"))
    p = segments.pair_essays_with_commentary(c, ["doc"])
    return p.select("doc", "score", F.md5("essay").alias("essay_md5"), F.md5("commentary").alias("commentary_md5"))


@query("u04_distinct_statements", f"WITH {POOL} SELECT count(DISTINCT statement) AS statements, count(DISTINCT id) AS ids, count(*) AS topics FROM pool")
def distinct_statements(spark, sf):
    return A.pool(spark, sf).agg(F.countDistinct("statement").alias("statements"), F.countDistinct("id").alias("ids"), F.count("*").alias("topics"))

