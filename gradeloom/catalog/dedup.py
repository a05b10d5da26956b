"""Duplicates and entity resolution."""

from pyspark.sql import functions as F

from gradeloom.catalog.base import KEPT, RANKED, grams, norm, query
from gradeloom.operators import components, dedup, quality
from gradeloom.operators.ordered import rank_within
from gradeloom.plans import corpus
from gradeloom.session import materialise
from gradeloom.sources import adapters as A


def kept(spark, sf):
    return quality.quality_filter(A.essays(spark, sf), tells="(?!)")


@query("d01_exact_survivors", f"WITH {RANKED} SELECT essay_id, duplicate_count FROM survivors")
def exact_survivors(spark, sf):
    return dedup.exact_dedup(kept(spark, sf))[0].select("essay_id", "duplicate_count")


@query("d01_collapsed_copies", f"""WITH {RANKED}
SELECT DISTINCT s.ordinal AS head, r.source_url FROM ranked r JOIN survivors s USING (key) WHERE r.rn > 1""")
def collapsed_copies(spark, sf):
    return dedup.exact_dedup(kept(spark, sf))[1]


@query("u03_url_lists", f"""WITH {RANKED}
SELECT s.ordinal AS head, string_agg(DISTINCT r.source_url, ' | ' ORDER BY r.source_url) AS duplicate_of_sources
FROM ranked r JOIN survivors s USING (key) WHERE r.rn > 1 GROUP BY 1""")
def url_lists(spark, sf):
    return dedup.render_links(dedup.exact_dedup(kept(spark, sf))[1])


@query("w01_survivor_rank", f"WITH {RANKED} SELECT ordinal, rn = 1 AS survives, copies FROM ranked")
def survivor_rank(spark, sf):
    k = dedup.with_key(kept(spark, sf)).withColumn("group_key", F.sha2("text_key", 256))
    return k.join(dedup.exact_groups(k), "group_key").select("ordinal", (F.col("ordinal") == F.col("head")).alias("survives"), "copies")


# Exact Jaccard over whole texts through an inverted index, then components.
_BRUTE = f"""{RANKED}, {grams('survivors', 'ordinal', 'key')},
size AS (SELECT ordinal, count(*) AS n FROM gram GROUP BY 1),
pair AS (SELECT a.ordinal AS a, b.ordinal AS b, count(*) AS c FROM gram a JOIN gram b ON a.g = b.g AND a.ordinal < b.ordinal GROUP BY 1, 2),
edge AS (SELECT a, b FROM pair JOIN size x ON x.ordinal = a JOIN size y ON y.ordinal = b WHERE c::DOUBLE / (x.n + y.n - c) >= 0.8),
bidi AS (SELECT a, b FROM edge UNION ALL SELECT b, a FROM edge),
reach AS (SELECT a AS node, a AS seen FROM bidi UNION SELECT r.node, e.b FROM reach r JOIN bidi e ON e.a = r.seen),
lab AS (SELECT node AS id, min(seen) AS label FROM reach GROUP BY 1)"""


def labels(spark, sf, verify="exact"):
    """Survivors and labels, from narrow rows and the keys alone: no text and no key goes along where copies are decided."""
    columns = ["ordinal", "essay_id", "score_type", "human_authenticity", "word_count", "source_url"]
    prompt = F.left("prompt_text", F.lit(1)).alias("prompt_text")
    keyed = materialise(dedup.with_key(kept(spark, sf)).select(*columns, prompt, "text_key"), "kept")
    narrow = keyed.select(*columns, "prompt_text", F.sha2("text_key", 256).alias("text_key"))
    survivors = materialise(dedup.exact_dedup(narrow)[0].drop("text_key"), "exact")
    keys = keyed.select("ordinal", "text_key").join(survivors.select("ordinal"), "ordinal", "left_semi")
    return survivors, dedup.near_duplicate_labels(keys, verify=verify)


@query("d03_near_duplicate_labels", f"WITH RECURSIVE {_BRUTE} SELECT id, label FROM lab")
def near_duplicate_labels(spark, sf):
    return labels(spark, sf)[1]


@query("j08_duplicate_links", f"WITH RECURSIVE {_BRUTE} SELECT label AS linked_to, id FROM lab WHERE id <> label")
def duplicate_links(spark, sf):
    """Candidates from shared bands, verified exactly and reduced to one link per copy."""
    return labels(spark, sf)[1].where("id <> label").select(F.col("label").alias("linked_to"), "id")


@query("d02_band_buckets")
def band_buckets(spark, sf):
    """Shared band buckets and their sizes, with estimated signatures only."""
    sk = dedup.sketches(A.table(spark, sf, "documents"), "doc_id", "text")
    return dedup.band_members(materialise(sk, "sketch")).groupBy("bucket").agg(F.count("*").alias("members"))


@query("d03_estimated_labels")
def estimated_labels(spark, sf):
    return labels(spark, sf, "estimate")[1]


@query("d05_cluster_survivors", f"""WITH RECURSIVE {_BRUTE}, m AS (SELECT s.*, coalesce(l.label, s.ordinal) AS cluster FROM survivors s LEFT JOIN lab l ON l.id = s.ordinal),
k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score_rank, auth_rank, CASE WHEN coalesce(prompt_text, '') <> '' THEN 0 ELSE 1 END, -word_count, ordinal) AS crn,
  sum(duplicate_count) OVER (PARTITION BY cluster) + count(*) OVER (PARTITION BY cluster) - 1 AS total FROM m)
SELECT essay_id, total::BIGINT AS duplicate_count FROM k WHERE crn = 1""")
def cluster_survivors(spark, sf):
    s, l = labels(spark, sf)
    _, links = dedup.exact_dedup(kept(spark, sf))
    return dedup.cluster_survivors(s, links, l)[0].select("essay_id", "duplicate_count")


_PARTS_AFTER = "(SELECT max(l_orderkey) + 1 FROM lineitem)"


@query("d04_components", f"""
WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS a, l_partkey + {_PARTS_AFTER} AS b FROM lineitem),
bidi AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
cc(id, label) USING KEY (id) AS (SELECT DISTINCT a AS id, a AS label FROM bidi
  UNION SELECT x.b AS id, min(cc.label) AS label FROM cc JOIN bidi x ON x.a = cc.id JOIN recurring.cc AS known ON known.id = x.b
  WHERE cc.label < known.label GROUP BY x.b)
SELECT id, label FROM cc""")
def component_labels(spark, sf):
    """Orders and parts of all line items; part keys lie above the order keys."""
    li = A.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    after = li.agg(F.max("l_orderkey") + 1).scalar()
    return components.star_components(li.select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") + after).alias("b")))


@query("d04_chains", """
WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders)
SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY rn % 7) AS label FROM o""")
def chain_labels(spark, sf):
    """Seven chains through all orders: each order hangs on the seventh one after it."""
    o = rank_within(A.table(spark, sf, "orders").select("o_orderkey"), [], "o_orderkey")
    after = o.select(F.col("o_orderkey").alias("after"), (F.col("rn") - 7).alias("rn"))
    chained = o.join(after, "rn", "left").select(F.col("o_orderkey").alias("a"), F.coalesce("after", "o_orderkey").alias("b"))
    return components.star_components(chained)


@query("d06_unique_ids", """
SELECT doc_id AS ordinal, source || CASE WHEN rn > 1 THEN '__' || (rn - 1) ELSE '' END AS essay_id
FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)""")
def unique_ids(spark, sf):
    d = A.table(spark, sf, "documents").select(F.col("doc_id").alias("ordinal"), F.col("source").alias("essay_id"))
    return dedup.unique_ids(d).select("ordinal", "essay_id")


@query("w07_repeat_counter", """
SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS repeat FROM events""")
def repeat_counter(spark, sf):
    from gradeloom.operators.ordered import rank_within
    e = A.table(spark, sf, "events").select("event_id", "event_type")
    return rank_within(e, ["event_type"], "event_id", width=1024).select("event_id", "event_type", (F.col("rn") - 1).alias("repeat"))


@query("d07_newest_snapshot", r"""
WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages)
SELECT host, max(page_id) AS ts FROM u GROUP BY 1""")
def newest_snapshot(spark, sf):
    p = A.cached_pages(spark, sf).withColumn("host", F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1))
    return dedup.newest_snapshot(p.select("host", "ts", "url"), "host").select("host", "ts")


@query("d08_first_accepted", """
SELECT source AS id, min(doc_id) AS ordinal FROM documents WHERE n_chars > 800 AND lang = 'en' GROUP BY 1""")
def first_accepted(spark, sf):
    d = A.table(spark, sf, "documents").select(F.col("source").alias("id"), F.col("doc_id").alias("ordinal"), "n_chars", "lang")
    return dedup.first_accepted(d, (F.col("n_chars") > 800) & (F.col("lang") == "en")).select("id", "ordinal")


@query("p01_build_corpus", f"""WITH RECURSIVE {_BRUTE}, m AS (SELECT s.*, coalesce(l.label, s.ordinal) AS cluster FROM survivors s LEFT JOIN lab l ON l.id = s.ordinal),
k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score_rank, auth_rank, CASE WHEN coalesce(prompt_text, '') <> '' THEN 0 ELSE 1 END, -word_count, ordinal) AS crn,
  first_value(ordinal) OVER (PARTITION BY cluster ORDER BY score_rank, auth_rank, CASE WHEN coalesce(prompt_text, '') <> '' THEN 0 ELSE 1 END, -word_count, ordinal) AS chead,
  sum(duplicate_count) OVER (PARTITION BY cluster) + count(*) OVER (PARTITION BY cluster) - 1 AS total FROM m),
url AS (SELECT k.chead AS head, r.source_url FROM ranked r JOIN k USING (key) WHERE r.rn > 1 AND k.crn = 1
  UNION SELECT chead, source_url FROM k WHERE crn > 1),
cell AS (SELECT head, string_agg(source_url, ' | ' ORDER BY source_url) AS duplicate_of_sources FROM url GROUP BY 1)
SELECT essay_id, total::BIGINT AS duplicate_count, duplicate_of_sources, sha1(essay_text) AS text_sha1,
  CASE score_type WHEN 'official' THEN 'A1_official' WHEN 'teacher_rated' THEN 'A2_teacher_rated' WHEN 'self_reported' THEN 'A2_teacher_rated'
    WHEN 'third_party_rated' THEN 'A3_community_rated' WHEN 'estimated' THEN 'B1_machine_scored' ELSE 'B2_unscored' END AS subtype
FROM k LEFT JOIN cell ON cell.head = k.ordinal WHERE crn = 1""")
def build_corpus(spark, sf):
    c = corpus.build_corpus(A.essays(spark, sf), tells="(?!)")
    return c.records.select("essay_id", "duplicate_count", "duplicate_of_sources", "text_sha1", "subtype")


@query("p01_flagship", f"""WITH {RANKED} SELECT source_name, count(*) AS kept, count(*) FILTER (WHERE score_available) AS scored,
  count(*) FILTER (WHERE human_authenticity = 'confirmed') AS confirmed, sum(duplicate_count)::BIGINT AS collapsed,
  min(CASE WHEN score_type = 'official' THEN 1 WHEN score_type IN ('teacher_rated', 'self_reported', 'third_party_rated') THEN 2
    WHEN human_authenticity IN ('confirmed', 'likely') THEN 3 ELSE 4 END)::INTEGER AS best_priority FROM survivors GROUP BY 1""")
def flagship(spark, sf):
    return corpus.flagship(A.essays(spark, sf))


@query("d01_empty_keys", f"WITH {KEPT} SELECT count(*) FILTER (WHERE {norm('essay_text')} = '') AS empty_keys FROM kept")
def empty_keys(spark, sf):
    return dedup.empty_key_count(kept(spark, sf))

