"""Record filters that keep the reason for every drop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import rules as R
from gradeloom.functions import text as X

# ---- fixed values: length limits and deny lists ------------------------------------------
MIN_WORDS, MAX_WORDS, MIN_WORDS_RATED = 100, 3000, 10
SOURCE_FLOORS = {"pages": 120, "threads": 120, "csv_corpus": 50, "sections": 100, "scored_documents": 10}
GUIDE_TITLES = (
    r"(?i)how to|tips |guide|strategy|template|all you need|masterclass|"
    r"question bank|vocab|resources|forum rules|percentile|study plan|"
    r"^poll|best gre books|sample essays|all topics"
)
POST_CONTEXT = r"(?i)\b(gre|awa|analytical writing|issue essay|argument essay)\b"
REMOVED_BODIES = ["[removed]", "[deleted]", ""]
# ------------------------------------------------------------------------------------------


def letter_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{L}+", ""))


def quality_reasons(df: DataFrame, min_words=MIN_WORDS, max_words=MAX_WORDS, min_rated=MIN_WORDS_RATED) -> DataFrame:
    """Add word_count and drop_reason; the checks apply in a fixed order."""
    measured = _measured(df)
    floor = F.when(F.col("score_type").isin("official", "teacher_rated"), min_rated).otherwise(min_words)
    wc = F.col("word_count")
    return measured.withColumn(
        "drop_reason",
        F.when(wc < floor, "too_short")
        .when(wc > max_words, "too_long")
        .when(F.col("_letters") < F.length("essay_text") * 0.5, "not_prose"),
    ).drop("_letters")


def _measured(df: DataFrame) -> DataFrame:
    """word_count (the stated one where there is one) and letter count, each computed once."""
    t = F.col("essay_text")
    counted = X.word_count(t)
    if "word_count" in df.columns:
        counted = X.let(F.col("word_count"), lambda stated: F.when(stated > 0, stated).otherwise(X.word_count(t)))
    return X.computed_once(df, word_count=counted, _letters=letter_count(t))


def quality_filter(df: DataFrame, tells: str = R.GENERATED_TEXT_TELLS, **limits) -> DataFrame:
    """Kept rows, with authenticity downgraded where the text shows a generator phrase."""
    kept = quality_reasons(df, **limits).where(F.col("drop_reason").isNull()).drop("drop_reason")
    kept = X.computed_once(kept, flagged_generated=F.coalesce(F.col("essay_text").rlike(tells), F.lit(False)))
    notes = F.col("notes") if "notes" in df.columns else F.lit(None).cast("string")
    auth, new_notes = R.downgraded(F.col("human_authenticity"), notes, F.col("flagged_generated"))
    return kept.withColumns({"human_authenticity": auth, "notes": new_notes})


def drop_counts(df: DataFrame, tells: str = R.GENERATED_TEXT_TELLS, **limits) -> DataFrame:
    """Rows per reason; flagged rows are counted although they stay."""
    marked = quality_reasons(df, **limits)
    reason = F.coalesce(
        F.col("drop_reason"),
        F.when(F.col("essay_text").rlike(tells), "flagged_generated"),
    )
    return marked.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(
        F.count("*").alias("n"))


def above_source_floor(df: DataFrame, floors: DataFrame, source: str = "source_name") -> DataFrame:
    """Keep rows that reach their source's own floor; a source without one keeps all."""
    return (
        df.join(floors, source, "left")
        .where(F.col("min_words").isNull() | (F.col("word_count") >= F.col("min_words")))
        .drop("min_words")
    )


def title_reason(title: Column, body: Column, pattern: str = GUIDE_TITLES) -> Column:
    return F.when(title.rlike(pattern), "guide").when(body.isNull(), "no_body")


def usable_post(title: Column, body: Column, context: str = POST_CONTEXT, removed=REMOVED_BODIES) -> Column:
    text = F.coalesce(body, F.lit(""))
    return ~text.isin(removed) & F.concat_ws(" ", F.coalesce(title, F.lit("")), text).rlike(context)


def topic_search(topics: DataFrame, query: str = "", variant: str | None = None) -> DataFrame:
    """Topics by variant and case-insensitive substring, with the 1-based match span."""
    needle = query.strip().lower()
    out = topics if variant is None else topics.where(F.col("variant") == variant)
    at = F.instr(F.lower("statement"), F.lit(needle)) if needle else F.lit(0)
    if needle:
        out = out.where(F.contains(F.lower("statement"), F.lit(needle)))
    return out.withColumns({"match_start": at.cast("int"), "match_length": F.lit(len(needle))})
