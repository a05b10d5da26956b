"""op1: documents linked at 90 percent of their three-word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeloom.llm.common import read
from gradeloom.llm.jaccard_join import components
from gradeloom.llm.registry import query

SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS s FROM w, unnest(range(1, greatest(len(ws) - 1, 2))) AS r(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 90 * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) LEFT JOIN n USING (doc_id)
"""


@query("op1_ngram_jaccard_join", SQL)
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(read(spark, sf_dir, "documents"), k=3, percent=90)
