"""Data-quality rules on the given tables."""

from pyspark.sql import functions as F

from gradeloom.catalog.base import POOL, query
from gradeloom.operators import checks as C
from gradeloom.plans import validate as V
from gradeloom.sources import adapters as A


def keyed(df):
    return df.select("rule_id", "key", "message")


@query("q01_expected_values", """
WITH want AS (SELECT unnest([0, 1, 2, 3]) AS quality), got AS (SELECT quality, count(*) AS n FROM (SELECT DISTINCT quality FROM labels) GROUP BY 1)
SELECT 'quality_levels' AS rule_id, coalesce(w.quality, g.quality)::VARCHAR AS key, 'has ' || coalesce(n, 0) || ', expected ' || (CASE WHEN w.quality IS NULL THEN 0 ELSE 1 END) AS message
FROM want w FULL JOIN got g ON w.quality = g.quality WHERE coalesce(n, 0) <> CASE WHEN w.quality IS NULL THEN 0 ELSE 1 END""")
def expected_values(spark, sf):
    return C.expected_values(A.table(spark, sf, "labels").select("quality").distinct(), "quality", [0, 1, 2, 3], "quality_levels")


@query("q02_group_sizes", """
WITH got AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), want AS (SELECT * FROM (VALUES ('en', 620), ('fr', 140), ('it', 1)) v(lang, w))
SELECT 'docs_per_language' AS rule_id, coalesce(g.lang, w.lang) AS key, 'has ' || coalesce(n, 0) || ', expected ' || coalesce(w, 0) AS message
FROM got g FULL JOIN want w ON g.lang = w.lang WHERE coalesce(n, 0) <> coalesce(w, 0)""")
def group_sizes(spark, sf):
    want = spark.createDataFrame([("en", 620), ("fr", 140), ("it", 1)], "lang string, expected bigint")
    return keyed(C.expected_counts(A.table(spark, sf, "documents"), ["lang"], want, "docs_per_language"))


@query("q03_length_range", "SELECT 'text_length' AS rule_id, doc_id::VARCHAR AS key, 'length ' || length(text) || ' out of range' AS message FROM documents WHERE length(text) NOT BETWEEN 50 AND 5000")
def length_range(spark, sf):
    return C.length_between(A.table(spark, sf, "documents"), "doc_id", F.col("text"), 50, 5000, "text_length")


@query("q03_min_tokens", r"""WITH n AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n FROM documents)
SELECT 'tokens' AS rule_id, doc_id::VARCHAR AS key, 'only ' || n || ' words' AS message FROM n WHERE n < 80""")
def min_tokens(spark, sf):
    return C.min_tokens(A.table(spark, sf, "documents"), "doc_id", F.col("text"), 80, "tokens")


@query("q04_foreign_key", "SELECT 'part_customer' AS rule_id, p_partkey::VARCHAR AS key FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)")
def foreign_key(spark, sf):
    """Part keys without a customer of the same key."""
    p = A.table(spark, sf, "part").select("p_partkey")
    return C.foreign_key(p, "p_partkey", A.table(spark, sf, "customer"), "c_custkey", "part_customer").select("rule_id", "key")


@query("q05_uniqueness", "SELECT 'repeated_text' AS rule_id, md5(text) AS key, 'occurs ' || count(*) || ' times' AS message FROM documents GROUP BY text HAVING count(*) > 1")
def uniqueness(spark, sf):
    return C.unique(A.table(spark, sf, "documents").select(F.md5("text").alias("h")), "h", "repeated_text")


@query("q06_leakage", r"""WITH h AS (SELECT item_id, array_to_string(list_slice(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''), 1, 10), ' ') AS head FROM benchmark)
SELECT doc_id, item_id FROM documents d JOIN h ON contains(d.text, h.head)""")
def leakage(spark, sf):
    """Benchmark heads that occur in a document."""
    d, b = A.table(spark, sf, "documents"), A.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("passage"))
    return C.leaked_heads_across(d, "doc_id", "text", b, "item_id", "passage")


@query("q07_forbidden_text", "SELECT 'license_line' AS rule_id, doc_id::VARCHAR AS key, 'forbidden text' AS message FROM documents WHERE regexp_matches(text, '(?i)license')")
def forbidden_text(spark, sf):
    return C.forbidden(A.table(spark, sf, "documents"), "doc_id", F.col("text"), "(?i)license", "license_line")


@query("q07_prefix", "SELECT 'opener' AS rule_id, doc_id::VARCHAR AS key, 'prefix missing' AS message FROM documents WHERE NOT starts_with(text, 'The ')")
def prefix(spark, sf):
    return C.prefix_rule(A.table(spark, sf, "documents"), "doc_id", F.col("text"), "The ", True, "opener")


@query("q08_array_size", f"""WITH {POOL} SELECT 'moves' AS rule_id, id AS key, 'has ' || (CASE WHEN ordinal % 5 = 0 THEN 2 ELSE 3 END) || ' entries' AS message FROM pool WHERE ordinal % 5 = 0
UNION ALL SELECT 'summary', id, 'not declared' FROM pool WHERE ordinal % 7 = 0""")
def array_size(spark, sf):
    """Topics damaged on purpose by a rule on their number."""
    p = A.pool(spark, sf).withColumn("required_moves", F.when(F.col("ordinal") % 5 == 0, F.slice("required_moves", 1, 2)).otherwise(F.col("required_moves")))
    p = p.withColumn("variant_summary", F.when(F.col("ordinal") % 7 != 0, F.col("variant_summary")))
    return C.all_of(C.array_size(p, "id", "required_moves", 3, "moves"), C.declared(p, "id", "variant_summary", "summary"))


@query("q09_gold_scores", """WITH g AS (SELECT doc_id AS id, CASE WHEN n_chars % 10 = 0 THEN 6.5 WHEN n_chars % 10 = 1 THEN 2.25 ELSE (doc_id % 13)::DOUBLE / 2 END AS s, text FROM documents)
SELECT 'gold_score' AS rule_id, id::VARCHAR AS key FROM g WHERE NOT (s BETWEEN 0 AND 6 AND s * 2 = floor(s * 2))
UNION ALL SELECT 'gold_leak', id::VARCHAR FROM g WHERE regexp_matches(text, 'Released under')
UNION ALL SELECT 'gold_essay', id::VARCHAR FROM g WHERE length(text) < 21""")
def gold_scores(spark, sf):
    n = F.col("n_chars") % 10
    s = F.when(n == 0, 6.5).when(n == 1, 2.25).otherwise((F.col("doc_id") % 13) / 2.0)
    g = A.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), s.alias("true_score"), F.col("text").alias("essay"), F.lit("a statement longer than twenty").alias("statement"))
    return V.validate_gold(g, leak="Released under").select("rule_id", "key")


@query("p07_validate_topics", f"""WITH {POOL}, c AS (SELECT variant, count(*) AS n FROM pool GROUP BY 1),
w AS (SELECT * FROM (VALUES ('statement', 53), ('claim_challenge', 26), ('claim_and_reason', 25), ('recommendation', 23), ('two_views', 20), ('policy', 11)) v(variant, w))
SELECT 'topic_id' AS rule_id, id AS key FROM pool GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'topics_per_variant', variant FROM c FULL JOIN w USING (variant) WHERE coalesce(n, 0) <> coalesce(w, 0)
UNION ALL SELECT 'statement_length', id FROM pool WHERE length(statement) NOT BETWEEN 50 AND 700""")
def validate_topics(spark, sf):
    return V.validate_topics(A.pool(spark, sf)).select("rule_id", "key")

