"""Raw sources to essay records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom import schema as S
from gradeloom.functions import html as H
from gradeloom.functions import rules as R
from gradeloom.functions import text as X
from gradeloom.operators import dedup, quality, segments
from gradeloom.operators import threads as T
from gradeloom.operators.labels import with_record_defaults
from gradeloom.operators.ordered import carry_forward, rank_within


def make_records(df: DataFrame, collected_at: str | None = None, **cols: Column) -> DataFrame:
    """Essay schema from the given columns; missing ones are NULL, blanks become NULL."""
    values = []
    for f in S.ESSAY.fields:
        c = cols.get(f.name, F.lit(None))
        if f.name == "word_count":
            c = X.word_count(cols["essay_text"])
        elif f.name == "collected_at":
            c = F.lit(collected_at).cast("date")
        values.append(c.cast(f.dataType).alias(f.name))
    extra = [F.col("ordinal")] if "ordinal" in df.columns else []
    return S.nulls_for_blank(with_record_defaults(df.select(*values, *extra)))


def parse_posts(posts: DataFrame, comments: DataFrame | None = None, prefix: str = "post", source_prefix: str = "Forum ",
                url_prefix: str = "", context: str = quality.POST_CONTEXT, collected_at: str | None = None,
                **lexicons) -> DataFrame:
    """Self-posts with ``ordinal``: own or community score, prompt split, essay test, first accepted per id."""
    clean = X.computed_once(posts, body=X.clean_text(F.col("selftext")), title=X.clean_text(F.col("title")))
    clean = clean.where(quality.usable_post(F.col("title"), F.col("body"), context))
    scored = X.computed_once(clean, _own=T.own_score(F.col("title"), F.col("body"))).withColumns({
        "score": F.col("_own.score"), "score_type": F.col("_own.score_type"), "evidence": F.col("_own.evidence")})
    if comments is not None:
        scored = T.fill_from_comments(scored, T.best_grader_comment(comments))
    split = T.split_post(scored)
    accepted = T.looks_like_essay(F.col("prompt"), F.col("essay"), F.col("score").isNotNull(), **lexicons)
    chosen = dedup.first_accepted(X.computed_once(split, _accepted=accepted), F.col("_accepted"))
    date = R.epoch_date(F.col("created_utc"))
    auth = F.when(F.coalesce(date < R.CUTOFF_DATE, F.lit(False)), "confirmed").otherwise("likely")
    has = F.col("score").isNotNull()
    return make_records(
        chosen, collected_at,
        essay_id=F.concat_ws("_", F.lit(prefix), "id"), essay_text=F.col("essay"),
        essay_type=R.classify_task(F.col("prompt"), F.col("essay"), F.col("title")), prompt_text=F.col("prompt"),
        prompt_category=F.when(F.col("prompt") != "", "user-pasted prompt").otherwise("not stated"),
        score=F.col("score"), score_type=F.when(has, F.col("score_type")).otherwise("none"),
        score_scale=F.when(has, "0-6"), human_authenticity=auth,
        exam_or_practice=T.exam_or_practice(has, F.col("body")), author_username=F.concat(F.lit("u/"), F.col("author")),
        source_name=F.concat(F.lit(source_prefix), F.col("subreddit")), source_url=F.concat(F.lit(url_prefix), F.col("permalink")),
        publication_date=date, evidence_for_score=F.col("evidence"),
        evidence_for_human_authorship=R.authorship_note(date, F.concat(F.lit("u/"), F.col("author"))),
        notes=F.concat_ws(" | ", F.concat(F.lit("Post title: "), F.left("title", F.lit(200))),
                          F.when(F.coalesce(F.col("flair"), F.lit("")) != "", F.concat(F.lit("flair: "), F.col("flair")))),
    )


def forum_rows(threads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(threads, posts) from array-shaped threads."""
    keyed = threads.withColumn("thread_id", F.col("u"))
    zipped = keyed.select("thread_id", F.posexplode(F.arrays_zip("b", "us")).alias("pos", "z"))
    posts = zipped.select("thread_id", "pos", F.col("z.us").alias("username"), F.col("z.b").alias("body"))
    return keyed.select("thread_id", F.col("t").alias("title"), F.col("u").alias("url"), F.col("d").alias("date_text")), posts


def parse_threads(threads: DataFrame, posts: DataFrame, dates: DataFrame | None = None, as_of: str | None = None,
                  source: str = "forum", prefix: str = "thread", min_words: int = 120, deny: str = quality.GUIDE_TITLES,
                  collected_at: str | None = None) -> DataFrame:
    """Forum threads: first post holds prompt and essay, replies may hold a score."""
    opening = posts.where("pos = 0").select("thread_id", "body")
    replies = posts.where("pos > 0 and body is not null").withColumn("body", X.clean_text(F.col("body")))
    t = threads.join(opening, "thread_id", "left")
    t = t.where(quality.title_reason(F.coalesce("title", F.lit("")), F.col("body"), deny).isNull())
    t = X.computed_once(t, body=X.clean_text(F.col("body")))
    t = X.computed_once(t, body=T.restore_paragraphs(F.col("body")))
    t = X.computed_once(t, _p=T.split_forum_post(F.col("body"))).where(X.word_count(F.col("_p.essay")) >= min_words)
    t = t.withColumns({
        "tid": F.regexp_extract("url", r"-(\d+)\.html$", 1), "parsed_date": R.forum_date(F.col("date_text"), as_of)})
    if dates is not None:
        t = T.with_thread_dates(t, dates)
    else:
        t = t.withColumn("publication_date", F.col("parsed_date"))
    t = t.join(T.first_scored_reply(replies).drop("pos"), "thread_id", "left").join(
        T.first_human_author(posts), "thread_id", "left")
    return make_records(
        t, collected_at,
        essay_id=X.essay_slug_id(prefix, F.element_at(F.split("url", "/"), -1)), essay_text=F.col("_p.essay"),
        essay_type=R.classify_task(F.col("_p.prompt"), F.col("_p.essay"), F.col("title")), prompt_text=F.col("_p.prompt"),
        score=F.col("score"), score_type=F.coalesce("score_type", F.lit("none")), score_scale=F.when(F.col("score").isNotNull(), "0-6"),
        human_authenticity=R.authenticity_from_date(F.col("publication_date"), after="likely"),
        exam_or_practice=F.lit("practice"), author_username=F.col("author"), source_name=F.lit(source), source_url=F.col("url"),
        publication_date=F.col("publication_date"), evidence_for_score=F.col("evidence"),
        evidence_for_human_authorship=R.authorship_note(F.col("publication_date"), F.col("author")),
    )


def parse_pages(pages: DataFrame, source: str = "archived pages", prefix: str = "page", min_words: int = 120,
                snapshots: bool = True, collected_at: str | None = None) -> DataFrame:
    """Archived pages (url, status, body): only status 200; prompt, body, author, date and machine score."""
    ok = pages.where("status = 200")
    ok = ok.withColumn("_s", H.snapshot_parts(F.col("url"))) if snapshots else ok.withColumn(
        "_s", F.struct(F.lit(None).cast("string").alias("ts"), F.col("url").alias("original")))
    blocks = X.computed_once(ok.where("_s is not null"), tree=H.html_tree("body")).select("_s", "tree", F.col("tree.blocks").alias("blocks"))
    parsed = X.computed_once(
        blocks.select("_s.ts", "_s.original", "tree", "blocks"), prompt=H.page_prompt(F.col("blocks")), essay=H.essay_body(F.col("tree")),
        meta=H.page_meta(F.col("blocks")), sc=H.page_scores(F.array_join(F.transform("blocks", lambda b: b.text), "\n")))
    parsed = parsed.where(X.word_count(F.col("essay")) >= min_words)
    tail = F.regexp_extract("original", r"^[a-z]+://[^/]+/(.*)$", 1)
    amended = F.contains(F.col("prompt"), F.lit("(Amended)")) | F.contains(F.lower("original"), F.lit("amended"))
    has = F.col("sc.machine_score").isNotNull()
    return make_records(
        parsed, collected_at,
        essay_id=X.essay_slug_id(prefix, tail), essay_text=F.col("essay"),
        essay_type=R.type_from_slug(F.element_at(F.split(tail, "/"), 1), F.col("prompt")), prompt_text=F.col("prompt"),
        score=F.col("sc.machine_score"), score_type=F.when(has, "estimated").otherwise("none"), score_scale=F.when(has, "0-6"),
        human_authenticity=R.authenticity_from_date(F.col("meta.date"), after="uncertain"), exam_or_practice=F.lit("practice"),
        author_username=F.col("meta.author"), source_name=F.lit(source), source_url=F.col("original"),
        publication_date=F.col("meta.date"),
        evidence_for_score=F.when(has, "Score of an automated grader shown on the page, not a rating by a person."),
        evidence_for_human_authorship=R.authorship_note(F.col("meta.date"), F.nullif(F.col("meta.author"), F.lit(""))),
        notes=F.concat_ws("; ", F.concat(F.lit("rates: "), F.col("sc.rates"), F.lit("/100")),
                          F.concat(F.lit("star rating: "), F.col("sc.stars"), F.lit("/10")),
                          F.when(amended, "marked as amended: may contain tutor corrections"),
                          F.concat(F.lit("snapshot "), F.col("ts"))),
    )


def heading_blocks(pages: DataFrame) -> DataFrame:
    """(doc, pos, kind, title, text): each heading of the article with the paragraphs up to the next heading."""
    trees = X.computed_once(pages.where("status = 200").select(F.col("url").alias("doc"), "body"), tree=H.html_tree("body"))
    rows = trees.select("doc", F.posexplode(H.article_blocks(F.col("tree"))).alias("pos", "b")).select("doc", "pos", "b.tag", "b.text")
    is_head = F.col("tag").isin("h2", "h3", "h4")
    placed = carry_forward(rows, ["doc"], "pos", {"at": F.when(is_head, F.col("pos"))}).where("at is not null")
    body = F.when(F.col("tag").isin("p", "blockquote", "li"), F.struct("pos", X.clean_text(F.col("text")).alias("t")))
    # One page is one cell of the source, so its paragraphs fit one cell again.
    grouped = placed.groupBy("doc", F.col("at").alias("pos")).agg(
        F.max(F.when(is_head, X.clean_text(F.col("text")))).alias("title"), F.array_sort(F.collect_list(body)).alias("l"))
    return grouped.select("doc", "pos", segments.block_kind(F.col("title")).alias("kind"), "title", F.array_join(
        F.transform(F.filter("l", lambda s: s.t != ""), lambda s: s.t), "\n\n").alias("text"))


def parse_sections(blocks: DataFrame, source: str = "scored samples", prefix: str = "sections", default_type: str = "issue",
                   min_words: int = 100, collected_at: str | None = None) -> DataFrame:
    """Student essays followed by a scored analysis."""
    found = segments.section_records(blocks, min_words=min_words).withColumn("score", H.section_score(F.col("analysis")))
    has = F.col("score").isNotNull()
    slug = F.regexp_replace(F.coalesce(F.get(F.reverse(F.split(F.col("doc").cast("string"), "/")), F.lit(1)), F.col("doc").cast("string")), "[^a-z0-9]+", "_")
    return make_records(
        found, collected_at,
        essay_id=F.concat_ws("_", F.lit(prefix), slug, F.col("n").cast("string")), essay_text=F.col("essay"),
        essay_type=F.lit(default_type),
        prompt_text=X.clean_text(X.strip_ws(F.concat(F.coalesce("prompt", F.lit("")), F.lit("\n\n"), F.coalesce("instructions", F.lit(""))))),
        prompt_category=F.coalesce("section", F.lit("publisher-selected prompt")), score=F.col("score"),
        score_type=F.when(has, "teacher_rated").otherwise("none"), score_scale=F.when(has, "0-6"),
        human_authenticity=F.lit("confirmed"), exam_or_practice=F.lit("practice"), source_name=F.lit(source),
        source_url=F.col("doc").cast("string"),
        notes=F.concat(F.lit("Section: "), F.coalesce("section", F.lit("")), F.lit(". Analysis excerpt: "), F.left("analysis", F.lit(300))),
    )


# ---- fixed values: markers of the official booklets ---------------------------------------
SAMPLE_MARKER = r"(?i)(?<!for )Essay Response\s*[\u2014\u2013\-]\s*Score\s*\d"
SAMPLE_CUT = r"Rater Commentary for Essay Response"
BOOKLET_MARKER = r"(?is)The following sample\s*(?:issue|argument)?\s*response received a\s*score\s*of\s*\d\s*:"
BOOKLET_CUT = (
    r"(?:Reader|Rater)\s+Commentary|Commentary on the (?:Issue|Argument)|"
    r"This (?:response|essay) (?:presents|earn|receive)"
)
# -------------------------------------------------------------------------------------------


def parse_scored_documents(docs: DataFrame, marker: str = SAMPLE_MARKER, cut: str = SAMPLE_CUT, source: str = "official samples",
                           prefix: str = "official", default_type: str = "issue", collected_at: str | None = None) -> DataFrame:
    """Published responses: one per score marker, commentary cut off, at least ten words."""
    segs = segments.segment(docs, marker)
    body = X.strip_noise(F.get(F.split("body", cut), F.lit(0)))
    found = X.computed_once(segs, essay=body).withColumns({
        "score": F.regexp_extract("marker", r"(\d)\D*$", 1).try_cast("double"),
        "named": F.lower(F.regexp_extract("marker", r"(?i)sample\s*(issue|argument)", 1))})
    order = F.col("part").cast("bigint") * (1 << 32) + F.col("seg_no")
    found = rank_within(found.withColumn("_o", order), ["doc"], "_o", out="n").where(X.word_count(F.col("essay")) >= 10)
    return make_records(
        found, collected_at,
        essay_id=F.concat_ws("_", F.lit(prefix), F.col("doc").cast("string"), F.col("n").cast("string"),
                             F.concat(F.lit("score"), F.col("score").cast("int").cast("string"))),
        essay_text=F.col("essay"), essay_type=F.coalesce(F.nullif("named", F.lit("")), F.lit(default_type)),
        score=F.col("score"), score_type=F.lit("official"), score_scale=F.lit("0-6"), human_authenticity=F.lit("confirmed"),
        exam_or_practice=F.lit("official_scored_sample"), source_name=F.lit(source), source_url=F.col("doc").cast("string"),
    )


def parse_csv_corpus(rows: DataFrame, prefix: str = "gre_", min_words: int = 50, source: str = "csv corpus",
                     publication_date: str | None = None, collected_at: str | None = None) -> DataFrame:
    """Rows (id, prompt, text, score_level) of a published corpus, selected by id prefix."""
    r = rows.where(F.startswith("id", F.lit(prefix))).withColumns({
        "prompt": X.strip_ws(F.coalesce("prompt", F.lit(""))), "essay": X.strip_ws(F.coalesce("text", F.lit("")))})
    r = r.where(X.word_count(F.col("essay")) >= min_words)
    task = R.type_from_question(R.classify_task(F.col("prompt"), F.col("essay"), F.lit("")), F.col("prompt"))
    return make_records(
        r, collected_at, essay_id=X.essay_slug_id("csv", F.col("id")), essay_text=F.col("essay"), essay_type=task,
        prompt_text=F.col("prompt"), score_type=F.lit("none"), human_authenticity=F.lit("confirmed"),
        exam_or_practice=F.lit("practice"), source_name=F.lit(source), publication_date=F.lit(publication_date),
        notes=F.when(F.coalesce(F.col("score_level"), F.lit("")) != "", F.concat(F.lit("proficiency_level: "), F.col("score_level"))),
    )
