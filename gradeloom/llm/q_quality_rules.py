"""op6: quality rules over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeloom.llm.common import read
from gradeloom.llm.quality_rules import MEASURES, judged
from gradeloom.llm.registry import query

SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars FROM t),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(range(1, len(ws) - 3)) AS r(i)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM twice, unnest(range(5)) AS r(j) GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(ls) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.*, len(ws)::BIGINT AS n_words, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(text) - length(replace(text, '!', '')) AS bangs, length(regexp_replace(text, '\P{Lu}+', '', 'g')) AS upper,
    word_chars - (length(text) - length(regexp_replace(text, '\p{L}+', '', 'g'))) AS odd,
    coalesce(list_max(list_transform(ws, lambda x: length(x))), 0) AS longest,
    len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS stutter
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 100 > word_chars * 6 OR bangs * 100 > word_chars * 8 OR upper * 100 > word_chars * 50
    OR (n_dup_lines * 100 > len(ls) * 40 AND len(ls) >= 4) OR odd * 100 > word_chars * 60 OR longest > 1000
    OR stutter * 100 > n_words * 30) AS kept
FROM b
"""


@query("op6_quality_rules", SQL)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs).select("doc_id", *MEASURES, "base_failed", "kept")
