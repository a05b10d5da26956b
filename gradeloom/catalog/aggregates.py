"""Aggregations and agreement metrics."""

from pyspark.sql import functions as F

from gradeloom.catalog.base import (
    ANCHORS, DOMAIN_RULES, ESSAYS, LABELLED, POOL, PREDS, RANKED, REASON, TELLS, TELLS_SQL, VARIANT_RULES, case_rules, query, r3, squeeze,
)
from gradeloom.functions.numbers import half_point_median
from gradeloom.operators import agreement, dedup, quality, stats, testsets
from gradeloom.operators.labels import label
from gradeloom.sources import adapters as A
from gradeloom.sources.writers import corpus_places


def labelled(spark, sf):
    return label(A.essays(spark, sf))


@query("a01_totals", f"""WITH {LABELLED}, o AS (SELECT word_count, row_number() OVER (ORDER BY word_count) - 1 AS i, count(*) OVER () AS n FROM labelled)
SELECT count(*) AS essays, count(*) FILTER (WHERE data_type = 'A') AS type_a, count(*) FILTER (WHERE data_type = 'B') AS type_b,
  sum(word_count)::BIGINT AS total_words, (SELECT word_count FROM o WHERE i = n // 2)::BIGINT AS median_words FROM labelled""")
def totals(spark, sf):
    return stats.totals(labelled(spark, sf))


@query("a02_score_types", f"WITH {ESSAYS} SELECT score_type, count(*) AS n FROM essays GROUP BY 1")
def score_types(spark, sf):
    return stats.count_by(A.essays(spark, sf), "score_type")


@query("a03_subtypes", f"""WITH {LABELLED} SELECT subtype, count(*) AS n,
  list_position(['A1_official', 'A2_teacher_rated', 'A3_community_rated', 'B1_machine_scored', 'B2_unscored'], subtype)::INTEGER AS tier_order FROM labelled GROUP BY 1""")
def subtypes(spark, sf):
    return stats.by_subtype(labelled(spark, sf))


@query("a04_score_histogram", f"WITH {ESSAYS} SELECT score, count(*) AS n, count(*) FILTER (WHERE score_type = 'official') AS official FROM essays WHERE score_available GROUP BY 1")
def score_histogram(spark, sf):
    return stats.score_histogram(A.essays(spark, sf))


@query("a05_authenticity_and_type", f"""WITH {ESSAYS} SELECT 'human_authenticity' AS dimension, human_authenticity AS value, count(*) AS n FROM essays GROUP BY 2
UNION ALL SELECT 'essay_type', essay_type, count(*) FROM essays GROUP BY 2""")
def authenticity_and_type(spark, sf):
    return stats.authenticity_and_type(A.essays(spark, sf))


@query("a06_sources", f"""WITH {ESSAYS} SELECT source_name, count(*) AS n, count(*) FILTER (WHERE score_available) AS scored,
  count(*) FILTER (WHERE human_authenticity = 'confirmed') AS confirmed, count(*) FILTER (WHERE human_authenticity = 'likely') AS likely,
  count(*) FILTER (WHERE human_authenticity = 'uncertain') AS uncertain FROM essays GROUP BY 1""")
def sources(spark, sf):
    return stats.by_source(A.essays(spark, sf))


@query("a07_years", f"WITH {ESSAYS} SELECT coalesce(left(publication_date, 4), '(unknown)') AS year, count(*) AS n FROM essays GROUP BY 1")
def years(spark, sf):
    return stats.by_year(A.essays(spark, sf))


@query("a08_duplicates_removed", f"WITH {RANKED} SELECT sum(duplicate_count)::BIGINT AS removed, count(*) AS kept FROM survivors")
def duplicates_removed(spark, sf):
    kept = quality.quality_filter(A.essays(spark, sf), tells="(?!)")
    return stats.duplicates_removed(dedup.exact_dedup(kept)[0])


@query("a09_source_report", f"""WITH {ESSAYS}, t AS (SELECT source_name, score_type, count(*) AS n FROM essays GROUP BY 1, 2),
a AS (SELECT source_name, human_authenticity, count(*) AS n FROM essays GROUP BY 1, 2)
SELECT source_name, (SELECT count(*) FROM essays e WHERE e.source_name = s.source_name) AS n,
  (SELECT count(*) FROM essays e WHERE e.source_name = s.source_name AND score_available) AS scored,
  (SELECT string_agg(score_type || ':' || n, ', ' ORDER BY n DESC, score_type) FROM t WHERE t.source_name = s.source_name) AS score_types,
  (SELECT string_agg(human_authenticity || ':' || n, ', ' ORDER BY n DESC, human_authenticity) FROM a WHERE a.source_name = s.source_name) AS authenticity
FROM (SELECT DISTINCT source_name FROM essays) s""")
def source_report(spark, sf):
    return stats.source_report(A.essays(spark, sf))


@query("a10_drop_counts", f"""WITH {ESSAYS}, r AS (SELECT coalesce({REASON}, CASE WHEN regexp_matches(essay_text, '{TELLS_SQL}') THEN 'flagged_generated' END) AS reason FROM essays)
SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1""")
def drop_counts(spark, sf):
    return quality.drop_counts(A.essays(spark, sf), TELLS)


_METRICS = f"""{PREDS}, e AS (SELECT *, predicted_score - true_score AS err, abs(predicted_score - true_score) AS ae,
  floor(true_score * 2 + 0.5)::DOUBLE AS a, floor(predicted_score * 2 + 0.5)::DOUBLE AS p,
  greatest(predicted_score, least(predicted_score + 0.5, 6)) - least(predicted_score, greatest(predicted_score - 0.5, 0)) AS spread FROM preds)"""
_COLS = f"""count(*) AS n, {r3('avg(err)')} AS bias, {r3('avg(ae)')} AS mae, {r3('avg(CASE WHEN ae <= 0.5 THEN 1.0 ELSE 0 END)')} AS within_half,
  {r3('avg(CASE WHEN ae <= 1 THEN 1.0 ELSE 0 END)')} AS within_one, {r3('avg(CASE WHEN err = 0 THEN 1.0 ELSE 0 END)')} AS exact,
  {r3('CASE WHEN sum(a*a) + sum(p*p) - 2 * sum(a) * sum(p) / count(*) = 0 THEN 0 ELSE 1 - sum((a-p)*(a-p)) / (sum(a*a) + sum(p*p) - 2 * sum(a) * sum(p) / count(*)) END')} AS qwk,
  {r3('avg(spread)')} AS mean_sample_spread"""


@query("a11_metrics", f"WITH {_METRICS} SELECT {_COLS} FROM e")
def metrics(spark, sf):
    return agreement.metrics(A.predictions(spark, sf))


@query("a12_kappa_from_matrix", f"""WITH {_METRICS}, o AS (SELECT a, p, count(*)::DOUBLE AS n FROM e GROUP BY 1, 2), t AS (SELECT sum(n) AS total FROM o),
x AS (SELECT a, sum(n) AS na FROM o GROUP BY 1), y AS (SELECT p, sum(n) AS np FROM o GROUP BY 1)
SELECT {r3("1 - (SELECT sum((a-p)*(a-p)*n) FROM o) / ((SELECT sum((x.a-y.p)*(x.a-y.p)*na*np) FROM x, y) / (SELECT total FROM t))")} AS qwk""")
def kappa_from_matrix(spark, sf):
    return agreement.kappa_from_confusion(agreement.confusion(A.predictions(spark, sf)))


@query("a13_sample_spread", f"WITH {_METRICS} SELECT label_source, {r3('avg(spread)')} AS mean_sample_spread FROM e GROUP BY 1")
def sample_spread(spark, sf):
    return agreement.metrics(A.predictions(spark, sf), ["label_source"]).select("label_source", "mean_sample_spread")


_LADDERS = f"""{PREDS}, pr AS (SELECT x.ladder, count(*) AS pairs, sum(CASE WHEN y.predicted_score > x.predicted_score THEN 1.0 WHEN y.predicted_score = x.predicted_score THEN 0.5 ELSE 0 END) AS correct
  FROM preds x JOIN preds y ON x.ladder = y.ladder AND x.true_score < y.true_score GROUP BY 1),
seq AS (SELECT ladder, predicted_score, lag(predicted_score) OVER (PARTITION BY ladder ORDER BY true_score, ordinal) AS prev FROM preds),
mono AS (SELECT ladder, count(*) AS items, bool_and(prev IS NULL OR predicted_score >= prev) AS ordered FROM seq GROUP BY 1)"""


@query("a14_ladder_accuracy", f"WITH {_LADDERS} SELECT ladder, items, ordered, coalesce({r3('correct / pairs')}, 0) AS pairwise_accuracy FROM mono LEFT JOIN pr USING (ladder) WHERE items >= 4")
def ladder_accuracy(spark, sf):
    return agreement.score_ladders(agreement.with_ladder(A.predictions(spark, sf)))


@query("j09_ladder_pairs", f"WITH {_LADDERS} SELECT ladder, pairs::DOUBLE AS pairs, correct::DOUBLE AS correct FROM pr")
def ladder_pairs(spark, sf):
    """Ordered pairs per ladder, counted between score cells."""
    cells = agreement.ladder_cells(agreement.with_ladder(A.predictions(spark, sf), 1))
    hi = cells.select("ladder", F.col("true_score").alias("ht"), F.col("predicted_score").alias("hp"), F.col("n").alias("hn"))
    w = (F.col("n") * F.col("hn")).cast("double")
    return cells.join(hi, "ladder").where("true_score < ht").groupBy("ladder").agg(
        F.sum(w).alias("pairs"),
        F.sum(F.when(F.col("hp") > F.col("predicted_score"), w).when(F.col("hp") == F.col("predicted_score"), w * 0.5).otherwise(0.0)).alias("correct"))


@query("w04_ladder_monotonic", f"WITH {_LADDERS} SELECT ladder, ordered FROM mono WHERE items >= 4")
def ladder_monotonic(spark, sf):
    return ladder_accuracy(spark, sf).select("ladder", "ordered")


@query("t04_ladder_groups", f"WITH {PREDS} SELECT ladder, count(*) AS items, min(true_score) AS lowest, max(true_score) AS highest FROM preds GROUP BY 1 HAVING count(*) >= 4")
def ladder_groups(spark, sf):
    return agreement.with_ladder(A.predictions(spark, sf)).groupBy("ladder").agg(
        F.count("*").alias("items"), F.min("true_score").alias("lowest"), F.max("true_score").alias("highest"))


@query("a15_metrics_by_cut", f"WITH {_METRICS} SELECT coalesce(label_source, 'all') AS cut, {_COLS} FROM e GROUP BY GROUPING SETS ((), (label_source))")
def metrics_by_cut(spark, sf):
    return agreement.metrics_by_cut(A.predictions(spark, sf))


@query("i09_scorer_comparison", f"""WITH {_METRICS}, two AS (SELECT 's' || (ordinal % 2) AS scorer_id, * FROM e)
SELECT scorer_id, coalesce(label_source, 'all') AS cut, {_COLS} FROM two GROUP BY GROUPING SETS ((scorer_id), (scorer_id, label_source))""")
def scorer_comparison(spark, sf):
    p = A.predictions(spark, sf).withColumn("scorer_id", F.concat(F.lit("s"), (F.col("ordinal") % 2).cast("string")))
    return agreement.metrics_by_cut(p, by=["scorer_id"])


@query("t01_worst_misses", f"WITH {PREDS} SELECT id, true_score, predicted_score, predicted_score - true_score AS error FROM preds ORDER BY abs(predicted_score - true_score) DESC, ordinal LIMIT 5")
def worst_misses(spark, sf):
    return agreement.worst_misses(A.predictions(spark, sf))


@query("t01_worst_misses_by_cut", f"""WITH {PREDS}, r AS (SELECT label_source, id, true_score, predicted_score, predicted_score - true_score AS error,
  row_number() OVER (PARTITION BY label_source ORDER BY abs(predicted_score - true_score) DESC, ordinal)::INTEGER AS rn FROM preds) SELECT * FROM r WHERE rn <= 5""")
def worst_misses_by_cut(spark, sf):
    return agreement.worst_misses(A.predictions(spark, sf), by=["label_source"])


@query("a16_length_bands", rf"""WITH {ANCHORS}, w AS (SELECT score::INTEGER AS score, len(list_filter(regexp_split_to_array(essay, '\s+'), lambda x: x <> '')) AS words FROM anchors),
c AS (SELECT score, words, count(*) AS n FROM w GROUP BY 1, 2)
SELECT score, (SELECT count(*) FROM w WHERE w.score = c.score) AS n, (SELECT round_even(quantile_cont(words, 0.5), 0)::INTEGER FROM w WHERE w.score = c.score) AS median_words,
  string_agg(words || 'x' || n, ' ' ORDER BY words) AS word_counts FROM c GROUP BY score""")
def length_bands(spark, sf):
    return stats.length_bands(A.anchors(spark, sf))


@query("a17_percentiles", f"""WITH {ESSAYS} SELECT essay_type, round_even(quantile_cont(word_count, 0.1), 0)::INTEGER AS p10, round_even(quantile_cont(word_count, 0.25), 0)::INTEGER AS p25,
  round_even(quantile_cont(word_count, 0.5), 0)::INTEGER AS median, round_even(quantile_cont(word_count, 0.75), 0)::INTEGER AS p75, round_even(quantile_cont(word_count, 0.9), 0)::INTEGER AS p90
FROM essays GROUP BY 1""")
def percentiles(spark, sf):
    return stats.percentiles(A.essays(spark, sf), "word_count", ["essay_type"])


@query("a18_topic_pool", f"""WITH {POOL}, o AS (SELECT length(statement) AS l, row_number() OVER (ORDER BY length(statement)) - 1 AS i, count(*) OVER () AS n FROM pool)
SELECT count(*) AS topics, count(*) - count(DISTINCT statement) AS repeated_statements, min(length(statement))::INTEGER AS min_len,
  (SELECT l FROM o WHERE i = n // 2)::INTEGER AS median_len, max(length(statement))::INTEGER AS max_len FROM pool""")
def topic_pool(spark, sf):
    return stats.topic_pool_stats(A.pool(spark, sf))


@query("a18_variant_counts", f"WITH {POOL} SELECT variant, count(*) AS n FROM pool GROUP BY 1")
def variant_counts(spark, sf):
    return stats.count_by(A.pool(spark, sf), "variant")


_REC = f"""{LABELLED}, rec AS (SELECT essay_id AS id, subtype, score, {case_rules(squeeze("'OPENER ' || essay_text"), VARIANT_RULES)} AS variant FROM labelled
  WHERE essay_type = 'argument' AND score IS NOT NULL AND subtype <> 'B2_unscored')"""


def records(spark, sf):
    """Scored argument records whose text carries the variant wording."""
    e = labelled(spark, sf).withColumn("prompt_text", F.concat(F.lit("S "), F.lit("OPENER "), F.col("essay_text")))
    return testsets.review_records(e, task="argument", opener="OPENER", rules=VARIANT_RULES)


@query("a19_tier_manifest", f"""WITH {_REC}, c AS (SELECT subtype, score, count(*) AS n, count(variant) AS v FROM rec GROUP BY 1, 2)
SELECT subtype AS label_source, sum(n)::BIGINT AS count, sum(v)::BIGINT AS variant_resolvable, string_agg(score::VARCHAR || ':' || n, ', ' ORDER BY score) AS score_distribution FROM c GROUP BY 1""")
def tier_manifest(spark, sf):
    return stats.tier_manifest(records(spark, sf))


@query("a20_top3_concentration", f"""WITH {_REC}, c AS (SELECT subtype, score, count(*) AS n FROM rec GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY subtype ORDER BY n DESC, score) AS rn FROM c)
SELECT subtype AS label_source, sum(n)::BIGINT AS count, round_even(sum(n) FILTER (WHERE rn <= 3)::DOUBLE / greatest(sum(n), 1), 3) AS concentration_top3 FROM r GROUP BY 1""")
def top3_concentration(spark, sf):
    return stats.top3_concentration(records(spark, sf), ["label_source"])


@query("t03_tier_order", f"""WITH {_REC}, o AS (SELECT id, subtype, score, row_number() OVER (PARTITION BY subtype ORDER BY score DESC, id)::INTEGER AS place FROM rec)
SELECT id, subtype AS label_source, place FROM o""")
def tier_order(spark, sf):
    """The place of every record in its tier report."""
    rows = records(spark, sf).select("id", "label_source", "true_score")
    return testsets.tier_places(rows).select("id", "label_source", F.col("place").cast("int").alias("place"))


@query("a22_usage_totals", """SELECT sum(n_chars)::BIGINT AS input, sum(n_chars * 3)::BIGINT AS cached, sum(doc_id % 100)::BIGINT AS cache_write, sum(n_chars // 4)::BIGINT AS output,
  (sum(n_chars) + sum(n_chars * 3) + sum(doc_id % 100))::BIGINT AS total_input,
  sum(n_chars * 3)::DOUBLE / (sum(n_chars) + sum(n_chars * 3) + sum(doc_id % 100))::DOUBLE AS cache_hit_rate FROM documents""")
def usage_totals(spark, sf):
    return stats.usage_totals(A.usage(spark, sf))


@query("a25_usage_per_item", """SELECT source AS item_id, sum(n_chars)::BIGINT AS input, sum(n_chars * 3)::BIGINT AS cached, sum(doc_id % 100)::BIGINT AS cache_write,
  sum(n_chars // 4)::BIGINT AS output, count(*) AS calls FROM documents GROUP BY 1""")
def usage_per_item(spark, sf):
    u = A.usage(spark, sf).join(A.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "source"), "item_id")
    return stats.usage_per_item(u.drop("item_id").withColumnRenamed("source", "item_id"))


@query("a24_sample_median", """
WITH s AS (SELECT doc_id, list_sort(CASE WHEN doc_id % 2 = 0 THEN [(doc_id % 13)::DOUBLE / 2, (n_chars % 13)::DOUBLE / 2] ELSE [(doc_id % 13)::DOUBLE / 2, (n_chars % 13)::DOUBLE / 2, (doc_id % 7)::DOUBLE / 2] END) AS v FROM documents)
SELECT doc_id, CASE WHEN len(v) % 2 = 1 THEN v[2] ELSE floor((v[1] + v[2]) / 2 * 2 + 0.5) / 2 END AS median FROM s""")
def sample_median(spark, sf):
    d, doc, n = A.table(spark, sf, "documents"), F.col("doc_id"), F.col("n_chars")
    s = F.when(doc % 2 == 0, F.array((doc % 13) / 2.0, (n % 13) / 2.0)).otherwise(F.array((doc % 13) / 2.0, (n % 13) / 2.0, (doc % 7) / 2.0))
    return d.select("doc_id", half_point_median(s).alias("median"))


_SPREAD = f"""{POOL}, dom AS (SELECT *, {case_rules('statement', DOMAIN_RULES, chr(39) + 'general' + chr(39))} AS domain FROM pool)"""


def spread(spark, sf):
    """Greedy spread over the six variants; statements stand under one or two of them."""
    p = A.pool(spark, sf)
    none = p.where("false").select("id", "statement", "instruction", "variant", "variant_summary", "required_moves",
                                   F.lit(True).alias("anchored"), F.col("id").alias("anchor_group"))
    from gradeloom.schema import VARIANTS
    return testsets.spread_prompts(p, none, VARIANTS, 4, DOMAIN_RULES)


def _spread_sql() -> str:
    from gradeloom.schema import VARIANTS
    steps, taken = [], "SELECT NULL::VARCHAR AS statement WHERE false"
    for i, v in enumerate(VARIANTS):
        steps.append(f"""v{i} AS (SELECT id, statement, variant, domain FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ordinal) AS dn FROM
          (SELECT * FROM dom WHERE variant = '{v}' AND statement NOT IN ({taken}))) ORDER BY CASE WHEN dn = 1 THEN 1 ELSE 2 END, ordinal LIMIT 4)""")
        taken = " UNION ALL ".join(f"SELECT statement FROM v{j}" for j in range(i + 1))
    return f"{_SPREAD}, {', '.join(steps)}, picked AS ({' UNION ALL '.join(f'SELECT * FROM v{i}' for i in range(len(VARIANTS)))})"


@query("w06_prompt_spread", f"WITH {_spread_sql()} SELECT id, variant, domain FROM picked")
def prompt_spread(spark, sf):
    return spread(spark, sf).select("id", "variant", "domain")


@query("a21_prompt_manifest", f"""WITH {_spread_sql()} SELECT 'variant' AS dimension, variant AS value, count(*) AS n, 0::BIGINT AS anchored FROM picked GROUP BY 2
UNION ALL SELECT 'domain', domain, count(*), 0 FROM picked GROUP BY 2 UNION ALL SELECT 'all', '', count(*), 0 FROM picked""")
def prompt_manifest(spark, sf):
    return testsets.prompt_manifest(spread(spark, sf))


@query("t02_corpus_order", f"""WITH {LABELLED}, o AS (SELECT essay_id, row_number() OVER (ORDER BY priority, source_name, essay_id) AS place FROM labelled)
SELECT essay_id, place FROM o""")
def corpus_order(spark, sf):
    """The place of every record in output order."""
    return corpus_places(labelled(spark, sf).select("essay_id", "priority", "source_name")).select("essay_id", "place")


@query("t05_shuffled_prefix")
def shuffled_prefix(spark, sf):
    """Report of the first fifty addresses of a fixed pseudo-random order."""
    from gradeloom.sources.readers import shuffled_prefix as take
    return take(A.table(spark, sf, "pages").select("page_id", "url"), "url", 50)

