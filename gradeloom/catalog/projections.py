"""Scalar text functions."""

from pyspark.sql import functions as F

from gradeloom.catalog.base import (
    DOMAIN_RULES, ESSAYS, LABELLED, POOL, TELLS, TELLS_SQL, VARIANT_RULES, case_rules, grams, nonblank, norm, query, r3, sents,
    squeeze, stated, strip, wc, words,
)
from gradeloom.functions import html as H
from gradeloom.functions import rules as R
from gradeloom.functions import text as X
from gradeloom.operators import stats
from gradeloom.operators import threads as T
from gradeloom.operators.labels import label
from gradeloom.sources import adapters as A


def docs(spark, sf):
    return A.table(spark, sf, "documents")


@query("x01_clean_text", rf"""
WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM documents)
SELECT doc_id, length(t)::INTEGER AS chars, md5(t) AS text_md5 FROM (
  SELECT doc_id, {strip("array_to_string(list_transform(string_split(t, chr(10)), lambda l: trim(l)), chr(10))")} AS t FROM c)""")
def clean_text(spark, sf):
    t = X.clean_text(F.col("text"))
    return docs(spark, sf).select("doc_id", F.length(t).alias("chars"), F.md5(t).alias("text_md5"))


@query("x02_norm_key", f"SELECT doc_id, {norm('text')} AS key FROM documents")
def norm_key(spark, sf):
    return docs(spark, sf).select("doc_id", X.norm_key(F.col("text")).alias("key"))


@query("x02_norm_key_ascii", f"SELECT doc_id, {norm('text', False)} AS key FROM documents")
def norm_key_ascii(spark, sf):
    return docs(spark, sf).select("doc_id", X.norm_key(F.col("text"), unicode=False).alias("key"))


@query("x03_word_count", f"SELECT doc_id, {wc('text')}::INTEGER AS words FROM documents")
def word_count(spark, sf):
    return docs(spark, sf).select("doc_id", X.word_count(F.col("text")).alias("words"))


@query("x04_tokenisers", rf"""SELECT doc_id, len({words('text')})::INTEGER AS signal_words,
  len(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*'))::INTEGER AS testset_words,
  len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::INTEGER AS space_words FROM documents""")
def tokenisers(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select("doc_id", F.size(X.signal_words(t)).alias("signal_words"),
                                  F.size(X.testset_words(t)).alias("testset_words"), F.size(X.space_words(t)).alias("space_words"))


@query("x05_sha1", "SELECT doc_id, sha1(text) AS text_sha1 FROM documents")
def sha1(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha1("text").alias("text_sha1"))


@query("x06_slug_id", """SELECT page_id, 'page_' || left(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 70)
  || '_' || left(sha1(url), 8) AS essay_id FROM pages""")
def slug_id(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", X.essay_slug_id("page", F.col("url")).alias("essay_id"))


@query("x07_topic_id", f"WITH {POOL} SELECT ordinal, variant, id FROM pool")
def topic_id(spark, sf):
    return A.pool(spark, sf).select("ordinal", "variant", "id")


@query("x08_shingles", f"""WITH {grams('documents', 'doc_id', norm('text'))}, c AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::INTEGER AS shingles FROM documents LEFT JOIN c USING (doc_id)""")
def shingles(spark, sf):
    keyed = docs(spark, sf).select("doc_id", X.norm_key(F.col("text")).alias("key"))
    return keyed.select("doc_id", F.size(X.shingle_hashes(F.col("key"))).alias("shingles"))


@query("x09_minhash_signature")
def minhash_signature(spark, sf):
    """Signatures of every document; equal texts have equal signatures."""
    from gradeloom.operators.dedup import sketches
    sk = sketches(docs(spark, sf), "doc_id", "text")
    return sk.select("id", F.size("sig").alias("slots"), F.xxhash64("sig").alias("sig_hash"), F.size("grams").alias("shingles"))


@query("x11_fold_typography", f"SELECT doc_id, md5({strip(squeeze('text'))}) AS text_md5 FROM documents")
def fold_typography(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.fold_typography(F.col("text"))).alias("text_md5"))


@query("x12_page_number_lines", r"""
WITH n AS (SELECT doc_id, '- ' || doc_id % 100 || ' -' || chr(10) || text || chr(10) || doc_id % 1000 AS text FROM documents)
SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)),
  lambda l: NOT regexp_matches(l, '^\s*(?:-\s*)?\d{1,3}(?:\s*-)?\s*$')), chr(10))) AS text_md5 FROM n""")
def page_number_lines(spark, sf):
    """Each text gets a page header and footer line first, so that there is something to drop."""
    doc = F.col("doc_id")
    paged = F.concat(F.lit("- "), (doc % 100).cast("string"), F.lit(" -\n"), F.col("text"), F.lit("\n"), (doc % 1000).cast("string"))
    return docs(spark, sf).select("doc_id", F.md5(X.drop_page_number_lines(paged)).alias("text_md5"))


@query("x13_first_sentences", rf"""
SELECT doc_id, {strip(r"array_to_string(list_slice(string_split(regexp_replace(text, '([.])\s+', '\1' || chr(1), 'g'), chr(1)), 1, 2), ' ')")} AS head FROM documents""")
def first_sentences(spark, sf):
    return docs(spark, sf).select("doc_id", X.first_sentences(F.col("text"), 2).alias("head"))


@query("x15_cut_trailer", rf"""SELECT doc_id, md5({strip(r"regexp_replace(text, '(?s)\s*(?:Released under|Licensed under).*$', '')")}) AS text_md5,
  regexp_matches(text, 'Released under|Licensed under') AS had_trailer FROM documents""")
def cut_trailer(spark, sf):
    trailers = ["Released under", "Licensed under"]
    return docs(spark, sf).select("doc_id", F.md5(X.cut_trailer(F.col("text"), trailers)).alias("text_md5"),
                                  F.col("text").rlike("|".join(trailers)).alias("had_trailer"))


@query("x19_sentences", f"SELECT doc_id, len({sents(strip('text'))})::INTEGER AS sentences FROM documents")
def sentences(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(X.sentences(X.strip_ws(F.col("text")))).alias("sentences"))


@query("x20_paragraphs", rf"""
WITH p AS (SELECT doc_id, len({nonblank(r"regexp_split_to_array(text, '\n\s*\n')")}) AS blank, len({nonblank("string_split(text, chr(10))")}) AS lines FROM documents)
SELECT doc_id, (CASE WHEN blank > 1 THEN blank WHEN lines > 1 THEN lines ELSE blank END)::INTEGER AS paragraphs FROM p""")
def paragraphs(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(X.paragraphs(F.col("text"))).alias("paragraphs"))


_TURNS = "WITH t AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1)"


@query("x21_blank_line_paragraphs", rf"""{_TURNS}
SELECT conv_id, CASE WHEN contains(text, chr(10)) THEN len({nonblank(r"regexp_split_to_array(text, '\n\s*\n')")})::INTEGER END AS paragraphs FROM t""")
def blank_line_paragraphs(spark, sf):
    """Conversation turns joined by blank lines give texts with real paragraph structure."""
    c = A.table(spark, sf, "conversations")
    spaced = c.withColumn("text", F.when(F.col("turn") > 0, F.concat(F.lit("\n"), F.col("text"))).otherwise(F.col("text")))
    from gradeloom.operators.segments import assemble_documents
    joined = assemble_documents(spaced, "conv_id", "turn")
    return joined.select("conv_id", X.blank_line_paragraph_count(F.col("text")).alias("paragraphs"))


_OPENER = "The |Les |Und "


@query("x32_split_prompt", rf"""
WITH s AS (SELECT doc_id, text, regexp_extract(text, '(?s)(?:{_OPENER}).*$', 0) AS found FROM documents)
SELECT doc_id, md5({strip("CASE WHEN found = '' THEN text ELSE left(text, length(text) - length(found)) END")}) AS statement_md5,
  md5(nullif({strip(squeeze('found'))}, '')) AS instruction_md5 FROM s""")
def split_prompt(spark, sf):
    p = R.split_prompt(F.col("text"), _OPENER)
    return docs(spark, sf).select("doc_id", p.alias("p")).select(
        "doc_id", F.md5("p.statement").alias("statement_md5"), F.md5("p.instruction").alias("instruction_md5"))


@query("x35_task_variant", f"SELECT doc_id, {case_rules('text', VARIANT_RULES)} AS variant FROM documents")
def task_variant(spark, sf):
    return docs(spark, sf).select("doc_id", R.classify_variant(F.col("text"), VARIANT_RULES).alias("variant"))


_ARG, _ISS, _TA, _TI, _BA, _BI = r"(?i) nd of ", r"(?i) th the ", r"src1$", r"src2$", r"(?i) (the|les|der) ", r"(?i) (and|des|und) "


@query("x36_classify_task", rf"""
WITH e AS (SELECT d.doc_id, b.text AS prompt, d.text, d.source FROM documents d {stated()}),
n AS (SELECT *, len(regexp_extract_all(text, '{_BA}')) AS a, len(regexp_extract_all(text, '{_BI}')) AS i FROM e)
SELECT doc_id, CASE WHEN regexp_matches(coalesce(prompt, ''), '{_ARG}') THEN 'argument' WHEN regexp_matches(coalesce(prompt, ''), '{_ISS}') THEN 'issue'
  WHEN regexp_matches(source, '{_TA}') THEN 'argument' WHEN regexp_matches(source, '{_TI}') THEN 'issue'
  WHEN a > i THEN 'argument' WHEN i > a THEN 'issue' ELSE 'unknown' END AS task FROM n""")
def classify_task(spark, sf):
    e = A.essays(spark, sf)
    task = R.classify_task(F.col("prompt_text"), F.col("essay_text"), F.col("source_name"), _ARG, _ISS, _TA, _TI, _BA, _BI)
    return e.select(F.col("ordinal").alias("doc_id"), task.alias("task"))


@query("x37_type_fallback", f"""WITH {ESSAYS}
SELECT essay_id, CASE WHEN contains(source_name, 'src1') THEN 'argument' WHEN contains(left(lower(prompt_text), 120), 'the following')
    OR contains(left(lower(prompt_text), 200), 'appeared in') THEN 'argument' ELSE 'issue' END AS by_slug,
  CASE WHEN essay_type = 'unknown' AND regexp_matches(prompt_text, '(?i)that the') THEN 'issue' ELSE essay_type END AS by_question FROM essays""")
def type_fallback(spark, sf):
    category = F.when(F.contains("source_name", F.lit("src1")), "argument-essays").otherwise("other")
    return A.essays(spark, sf).select(
        "essay_id", R.type_from_slug(category, F.col("prompt_text")).alias("by_slug"),
        R.type_from_question(F.col("essay_type"), F.col("prompt_text"), r"(?i)that the").alias("by_question"))


_MARK, _NOUN, _REG, _META = r"(?i)\bthe\b", r"(?i)\b(of the|to the|the a)\b", r"(?i)\b(in the|and the)\b", r"(?i)\b(for the|that that)\b"


@query("x38_looks_like_essay", rf"""
WITH m AS (SELECT doc_id, text, {wc('text')} AS w, len(list_filter(string_split(text, chr(10)), lambda p: len(regexp_extract_all(p, '[A-Za-z0-9'']+')) > 20)) AS paras,
  len(regexp_extract_all(text, '(?m)^\s*[-*\d]+[.)]\s')) AS bullets,
  (CASE WHEN regexp_matches(text, '(?i)license') THEN 2 ELSE 0 END) + (CASE WHEN len(regexp_extract_all(text, '{_NOUN}')) >= 3 THEN 1 ELSE 0 END)
   + (CASE WHEN len(regexp_extract_all(text, '{_REG}')) >= 2 THEN 1 ELSE 0 END) AS ev,
  len(regexp_extract_all(text, '{_META}')) AS meta, doc_id % 2 = 0 AS relaxed FROM documents)
SELECT doc_id, w >= 80 AND regexp_matches(text, '{_MARK}') AND paras >= 3 AND bullets <= 4 AND ev > 0
  AND CASE WHEN relaxed THEN meta <= 3 OR ev >= 2 ELSE meta < 3 AND NOT (meta >= 1 AND ev < 2) END AS is_essay FROM m""")
def looks_like_essay(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select("doc_id", T.looks_like_essay(
        F.lit(""), t, F.col("doc_id") % 2 == 0, _MARK, _NOUN, _REG, _META, min_words=80, long_paragraph=20,
        task_prompt=t.rlike("(?i)license")).alias("is_essay"))


@query("x42_dates", """
SELECT doc_id, strftime(DATE '2010-01-01' + doc_id::INTEGER, '%Y-%m-%d') AS iso_date,
  CASE WHEN doc_id <> 0 THEN strftime(DATE '1970-01-01' + (doc_id * 100000 // 86400)::INTEGER, '%Y-%m-%d') END AS epoch_day FROM documents""")
def dates(spark, sf):
    """The same day printed in one of three layouts per row, then parsed back."""
    doc = F.col("doc_id")
    day = F.date_add(F.lit("2010-01-01").cast("date"), doc.cast("int"))
    text = (
        F.when(doc % 3 == 0, F.date_format(day, "MM/dd/yyyy")).when(doc % 3 == 1, F.date_format(day, "dd MMMM yyyy"))
        .otherwise(F.date_format(day, "MMMM d, yyyy")))
    return docs(spark, sf).select(
        "doc_id", R.iso_date_from_text(text).alias("iso_date"), R.epoch_date(doc * 100000).alias("epoch_day"))


@query("x43_authenticity", f"""WITH {ESSAYS}
SELECT essay_id, CASE WHEN publication_date IS NULL THEN 'likely' WHEN publication_date > '2022-11-30' THEN 'uncertain' ELSE 'confirmed' END AS page_policy,
  CASE WHEN publication_date IS NULL THEN 'likely' WHEN publication_date > '2022-11-30' THEN 'likely' ELSE 'confirmed' END AS thread_policy,
  CASE WHEN publication_date IS NULL THEN 'likely' WHEN publication_date < '2022-11-30' THEN 'confirmed' ELSE 'likely' END AS post_policy FROM essays""")
def authenticity(spark, sf):
    d = F.col("publication_date")
    return A.essays(spark, sf).select(
        "essay_id", R.authenticity_from_date(d, "uncertain").alias("page_policy"), R.authenticity_from_date(d, "likely").alias("thread_policy"),
        R.authenticity_from_date(d, "likely", cutoff_counts_as_after=True).alias("post_policy"))


@query("x46_canonical_url", r"""
WITH u AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host,
  list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)?', 1), '/'), lambda s: s <> '') AS segs FROM pages)
SELECT page_id, CASE WHEN NOT contains(url, '?') AND NOT contains(url, '#') AND host <> '' AND len(segs) = 2
  THEN 'https://' || host || '/' || array_to_string(segs, '/') END AS canonical_url FROM u""")
def canonical_url(spark, sf):
    return A.table(spark, sf, "pages").select("page_id", H.canonical_url(F.col("url")).alias("canonical_url"))


@query("x47_snapshot_url", "SELECT page_id, lpad(page_id::VARCHAR, 14, '2') AS ts, url AS original FROM pages")
def snapshot_url(spark, sf):
    p = A.table(spark, sf, "pages")
    wrapped = F.concat(F.lit("https://archive.example/web/"), F.lpad(F.col("page_id").cast("string"), 14, "2"), F.lit("id_/"), F.col("url"))
    return p.select("page_id", H.snapshot_parts(wrapped).alias("s")).select("page_id", "s.ts", "s.original")


@query("x48_page_blocks")
def page_blocks(spark, sf):
    """Prompt, body and meta extracted from every page."""
    t = X.computed_once(A.table(spark, sf, "pages"), tree=H.html_tree("html")).select("page_id", "tree", F.col("tree.blocks").alias("blocks"))
    return t.select("page_id", F.size("blocks").alias("blocks"), H.page_prompt(F.col("blocks")).alias("prompt"),
                    X.word_count(H.essay_body(F.col("tree"))).alias("body_words"), H.page_meta(F.col("blocks"))["author"].alias("author"))


# fixed values: the character references of the given pages; tags and references part words, but for the apostrophe
_REFERENCES = {"&nbsp;": " ", "&copy;": " ", "&quot;": " ", "&lt;": " ", "&gt;": " ", "&middot;": " ", "&#39;": "''", "&#x27;": "''", "&amp;": " ", "&amp": " "}
_PLAIN = r"regexp_replace(regexp_replace({0}, '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g')"
for _r, _c in _REFERENCES.items():
    _PLAIN = f"replace({_PLAIN}, '{_r}', '{_c}')"


@query("x48_article_text", rf"""
WITH a AS (SELECT page_id, regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) AS art FROM pages)
SELECT page_id, {wc(_PLAIN.format('art'))} AS words, len(regexp_extract_all(art, '<p>'))::INTEGER AS paragraphs,
  md5(array_to_string(regexp_extract_all({_PLAIN.format('art')}, '[A-Za-z0-9'']+'), ' ')) AS words_md5 FROM a""")
def article_text(spark, sf):
    """Words of the article alone: menus, adverts and footers lie outside its range."""
    t = X.computed_once(A.table(spark, sf, "pages"), tree=H.html_tree("html"))
    b = X.computed_once(t, b=H.article_blocks(F.col("tree")))
    text = F.array_join(F.transform("b", lambda x: x["text"]), " ")
    return b.select("page_id", X.word_count(text).alias("words"), F.size(F.filter("b", lambda x: x["tag"] == "p")).alias("paragraphs"),
                    F.md5(F.array_join(F.regexp_extract_all(text, F.lit("[A-Za-z0-9']+"), F.lit(0)), " ")).alias("words_md5"))


@query("x49_domain", f"SELECT item_id, {case_rules('text', DOMAIN_RULES, chr(39) + 'general' + chr(39))} AS domain FROM benchmark")
def domain(spark, sf):
    return A.table(spark, sf, "benchmark").select("item_id", R.domain_of(F.col("text"), DOMAIN_RULES).alias("domain"))


@query("x50_cost", f"""
SELECT doc_id AS item_id, {r3('n_chars * 3e-6 + (doc_id % 100) * 3e-6 * 1.25 + n_chars * 3 * 3e-6 * 0.1 + (n_chars // 4) * 15e-6', 6)} AS cost FROM documents""")
def cost(spark, sf):
    from gradeloom.functions.numbers import round_up_half
    return A.usage(spark, sf).select("item_id", round_up_half(stats.estimated_cost(), 6).alias("cost"))


@query("x51_generated_flag", rf"""WITH {ESSAYS}
SELECT essay_id, CASE WHEN regexp_matches(essay_text, '{TELLS_SQL}') THEN 'uncertain' ELSE human_authenticity END AS human_authenticity,
  CASE WHEN regexp_matches(essay_text, '{TELLS_SQL}') THEN '{R.GENERATED_TEXT_NOTE}' END AS notes FROM essays""")
def generated_flag(spark, sf):
    auth, notes, _ = R.flag_generated(F.col("human_authenticity"), F.lit(None).cast("string"), F.col("essay_text"), TELLS)
    return A.essays(spark, sf).select("essay_id", auth.alias("human_authenticity"), notes.alias("notes"))


@query("x52_labels", f"WITH {LABELLED} SELECT essay_id, subtype, data_type, priority, sha1(essay_text) AS text_sha1 FROM labelled")
def labels(spark, sf):
    return label(A.essays(spark, sf)).select("essay_id", "subtype", "data_type", "priority", "text_sha1")


@query("x14_strip_noise", rf"""
WITH k AS (SELECT doc_id, array_to_string(list_transform(list_filter(string_split(text, chr(10)),
  lambda l: NOT regexp_matches(l, '^\s*$|(?i)the\s*$')), lambda l: {strip('l')}), ' ') AS t FROM documents)
SELECT doc_id, md5({strip(squeeze('t'))}) AS text_md5 FROM k""")
def strip_noise(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(X.strip_noise(F.col("text"), [r"^\s*$", r"(?i)the\s*$"])).alias("text_md5"))

