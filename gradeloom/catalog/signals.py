"""Writing signals."""

from pyspark.sql import functions as F

from gradeloom.catalog.base import CONCESSION, FORMULAIC, STOP, content, marker_list, nonblank, query, r3, sents, squeeze, stated, strip, words
from gradeloom.functions import signals as S
from gradeloom.functions import text as X
from gradeloom.sources import adapters as A

_T = strip("d.text")
SIGNALS = rf"""
base AS (SELECT d.doc_id, {_T} AS t, coalesce(b.text, '') AS s FROM documents d {stated()}),
toks AS (SELECT *, {words('t')} AS w, {sents('t')} AS sent, {content(words('s'), STOP)} AS pc,
  len({nonblank(r"regexp_split_to_array(t, '\n\s*\n')")}) AS blank, len({nonblank("string_split(t, chr(10))")}) AS lines FROM base),
nums AS (SELECT *, len(w) AS n, len(sent) AS sn, CASE WHEN blank > 1 THEN blank WHEN lines > 1 THEN lines ELSE blank END AS paras,
  list_transform(sent, lambda x: len({words('x')})) AS lens, {content(words("coalesce(sent[1], '')"), STOP)} AS fw,
  CASE WHEN len(pc) > 0 THEN len(list_intersect(pc, list_distinct(w)))::DOUBLE / len(pc) ELSE 0 END AS overlap FROM toks),
spread AS (SELECT *, coalesce(list_sum(lens), 0)::DOUBLE AS s1, coalesce(list_sum(list_transform(lens, lambda v: v * v)), 0)::DOUBLE AS s2,
  len(list_intersect(fw, pc)) AS echoed, left(lower({squeeze('t')}), 200) AS head, lower({squeeze('s')}) AS ls FROM nums),
signals AS (SELECT doc_id, n::INTEGER AS word_count, paras::INTEGER AS paragraph_count, sn::INTEGER AS sentence_count,
  CASE WHEN sn > 0 THEN {r3('n::DOUBLE / sn', 1)} ELSE 0 END AS mean_sentence_words,
  CASE WHEN sn < 2 THEN 0 ELSE {r3('sqrt(greatest((s2 - s1 * s1 / sn) / (sn - 1), 0))', 1)} END AS sentence_length_stdev,
  {r3('overlap', 2)} AS prompt_overlap,
  len(fw) >= 4 AND len(pc) > 0 AND (CASE WHEN least(len(fw), len(pc)) > 0 THEN echoed::DOUBLE / least(len(fw), len(pc)) ELSE 0 END) >= 0.7 AS opens_by_restating_prompt,
  array_to_string({marker_list('t', CONCESSION)}, '|') AS concession, array_to_string({marker_list('t', FORMULAIC)}, '|') AS formulaic,
  concat_ws(',', CASE WHEN n = 0 THEN 'empty' END, CASE WHEN n > 0 AND n < 50 THEN 'extremely_short' END,
    CASE WHEN n >= 50 AND overlap < 0.15 THEN 'off_topic' END, CASE WHEN paras = 1 AND n > 150 THEN 'single_paragraph' END,
    CASE WHEN length(head) > 0 AND contains(ls, head) THEN 'copies_prompt' END) AS flags FROM spread)"""


def pairs(spark, sf):
    """Every document against the statement it is assigned to."""
    d = A.table(spark, sf, "documents").select("doc_id", F.col("text").alias("essay"))
    return A.with_statement(d, spark, sf)


def scored(spark, sf):
    return S.with_signals(pairs(spark, sf), "essay", "statement", CONCESSION, FORMULAIC, STOP)


@query("x30_signals", f"WITH {SIGNALS} SELECT * FROM signals")
def signals(spark, sf):
    s = scored(spark, sf).select("doc_id", "signals.*")
    return s.select(
        "doc_id", "word_count", "paragraph_count", "sentence_count", "mean_sentence_words", "sentence_length_stdev",
        "prompt_overlap", "opens_by_restating_prompt", F.array_join("concession_markers", "|").alias("concession"),
        F.array_join("formulaic_markers", "|").alias("formulaic"), F.array_join("flags", ",").alias("flags"))


@query("x22_content_words", f"SELECT doc_id, array_to_string(list_sort({content(words('text'), STOP)}), ' ') AS content_words FROM documents")
def content_words(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(
        S.content_words(X.signal_words(F.col("text")), STOP)), " ").alias("content_words"))


@query("x23_markers", f"SELECT doc_id, array_to_string({marker_list('text', CONCESSION)}, '|') AS markers FROM documents")
def markers(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", F.array_join(S.markers(F.col("text"), CONCESSION), "|").alias("markers"))


_TOKENS = rf"list_filter(list_transform(list_slice(regexp_split_to_array(s, '\s+'), 2, 100000), lambda w: regexp_replace(w, '[^A-Za-z''-]', '', 'g')), lambda w: length(w) > 2 AND regexp_matches(w, '^[A-Z][a-z]'))"


@query("x24_specificity", rf"""
WITH x AS (SELECT doc_id, t, flatten(list_transform({sents('t')}, lambda s: {_TOKENS})) AS names FROM (SELECT doc_id, {strip('text')} AS t FROM documents)),
a AS (SELECT doc_id, list_concat(names, regexp_extract_all(t, '\b(1[0-9]{{3}}|20[0-9]{{2}})\b')) AS found FROM x)
SELECT doc_id, array_to_string(list_slice(list_filter(found, lambda v, i: list_position(found, v) = i), 1, 25), '|') AS specificity FROM a""")
def specificity(spark, sf):
    """No figures with units occur in the given texts, so names and years decide."""
    t = X.strip_ws(F.col("text"))
    return A.table(spark, sf, "documents").select("doc_id", F.array_join(S.specificity(t, X.sentences(t)), "|").alias("specificity"))


@query("x25_sentence_spread", f"WITH {SIGNALS} SELECT doc_id, mean_sentence_words, sentence_length_stdev FROM signals")
def sentence_spread(spark, sf):
    return scored(spark, sf).select("doc_id", "signals.mean_sentence_words", "signals.sentence_length_stdev")


@query("x26_prompt_overlap", f"WITH {SIGNALS} SELECT doc_id, prompt_overlap FROM signals")
def prompt_overlap(spark, sf):
    return scored(spark, sf).select("doc_id", "signals.prompt_overlap")


@query("x27_restates_prompt", f"""WITH b AS (SELECT doc_id, {content(words("coalesce(" + sents(strip('text')) + "[1], '')"), STOP)} AS fw, {content(words('text'), STOP)} AS pc FROM documents)
SELECT doc_id, len(fw) >= 4 AND len(pc) > 0 AND (CASE WHEN least(len(fw), len(pc)) > 0 THEN len(list_intersect(fw, pc))::DOUBLE / least(len(fw), len(pc)) ELSE 0 END) >= 0.7 AS restates FROM b""")
def restates_prompt(spark, sf):
    """Each document's opening against its own full text, so that both answers occur."""
    t = F.col("text")
    first = S.content_words(X.signal_words(F.coalesce(F.get(X.sentences(X.strip_ws(t)), F.lit(0)), F.lit(""))), STOP)
    return A.table(spark, sf, "documents").select("doc_id", first.alias("f"), S.content_words(X.signal_words(t), STOP).alias("p")).select(
        "doc_id", S.restates(F.col("f"), F.col("p")).alias("restates"))


@query("x28_flags", f"WITH {SIGNALS} SELECT doc_id, flags FROM signals WHERE flags <> ''")
def flags(spark, sf):
    return scored(spark, sf).select("doc_id", F.array_join("signals.flags", ",").alias("flags")).where("flags <> ''")


@query("x29_mechanical_zero", f"""WITH z AS (SELECT doc_id, left(lower({squeeze(strip('text'))}), 200) AS head, lower({squeeze('text')}) AS s FROM documents)
SELECT doc_id, length(head) = 0 OR doc_id % 3 = 0 AS zero FROM z WHERE contains(s, head) OR head = ''""")
def mechanical_zero(spark, sf):
    """Every third document is submitted against its own text and so copies the prompt."""
    d = A.table(spark, sf, "documents").select("doc_id", F.col("text").alias("essay"), F.when(
        F.col("doc_id") % 3 == 0, F.col("text")).otherwise("nothing in common").alias("statement"))
    s = S.with_signals(d, "essay", "statement", CONCESSION, FORMULAIC, STOP)
    return s.select("doc_id", S.is_mechanical_zero(F.col("signals.flags")).alias("zero"))


def _listed(expr: str, none: str = "none found") -> str:
    return f"coalesce(nullif(replace({expr}, '|', ', '), ''), '{none}') || '.'"


def _printed(expr: str) -> str:
    return f"regexp_replace(({expr})::DOUBLE::VARCHAR, '[.]0$', '')"


@query("x31_rendered_signals", rf"""WITH {SIGNALS},
x AS (SELECT doc_id, t, flatten(list_transform({sents('t')}, lambda s: {_TOKENS})) AS names FROM (SELECT doc_id, {strip('text')} AS t FROM documents)),
y AS (SELECT doc_id, list_concat(names, regexp_extract_all(t, '\b(1[0-9]{{3}}|20[0-9]{{2}})\b')) AS found FROM x),
z AS (SELECT doc_id, array_to_string(list_slice(list_filter(found, lambda v, i: list_position(found, v) = i), 1, 25), '|') AS specificity FROM y)
SELECT doc_id, concat_ws(chr(10), 'Length: ' || word_count || ' words, ' || paragraph_count || ' paragraph(s), ' || sentence_count || ' sentences.',
  'Sentence length: mean ' || {_printed('mean_sentence_words')} || ' words, standard deviation ' || {_printed('sentence_length_stdev')} || '.',
  'Topical overlap with the prompt: ' || floor(prompt_overlap * 100 + 0.5)::BIGINT || '% of prompt content words appear in the response.',
  'Opens by restating the prompt: ' || CASE WHEN opens_by_restating_prompt THEN 'yes' ELSE 'no' END || '.',
  'Concession/counterargument markers: ' || {_listed('concession')}, 'Proper nouns, dates and figures: ' || {_listed('specificity')},
  'Formulaic signposting: ' || {_listed('formulaic')}, 'Mechanical flags: ' || {_listed("replace(flags, ',', '|')", 'none')}) AS rendered
FROM signals JOIN z USING (doc_id)""")
def rendered_signals(spark, sf):
    return scored(spark, sf).select("doc_id", S.render_signals().alias("rendered"))
