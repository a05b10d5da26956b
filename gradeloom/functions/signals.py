"""Deterministic writing signals: evidence about a response, never a verdict."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import text as X
from gradeloom.functions.numbers import round_up_half

# ---- fixed values: lexicons that decide the signals --------------------------------------
CONCESSION = [
    "however", "although", "though", "while it is true", "admittedly", "granted", "critics", "opponents",
    "some argue", "some may argue", "one might object", "on the other hand", "conversely", "nevertheless",
    "nonetheless", "to be sure", "detractors", "skeptics", "concede", "counterargument", "despite",
    "in spite of", "yet",
]
FORMULAIC = [
    "firstly", "secondly", "thirdly", "lastly", "in conclusion", "to conclude", "in summary", "to sum up",
    "this essay will", "i will argue", "first of all", "last but not least", "moreover", "furthermore",
    "in today's world", "in modern society", "since the dawn", "multifaceted", "delve into",
    "plays a pivotal role", "it is worth noting",
]
STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "if", "of", "to", "in", "on", "at", "for", "with", "by", "from", "as",
    "is", "are", "was", "were", "be", "been", "being", "that", "this", "these", "those", "it", "its", "they",
    "them", "their", "we", "our", "you", "your", "he", "she", "his", "her", "not", "no", "can", "could", "will",
    "would", "should", "may", "might", "must", "do", "does", "did", "have", "has", "had", "than", "then", "so",
    "such", "more", "most", "some", "any", "all", "there", "which", "who", "what", "when", "where", "how",
    "why", "about", "into", "through", "during", "own", "same", "other", "only", "also", "very", "one", "two",
    "people",
]
YEAR = r"\b(1[0-9]{3}|20[0-9]{2})\b"
FIGURE = r"(?i)\b\d+(?:\.\d+)?\s?(?:percent|%|million|billion)\b"
OFF_TOPIC_BELOW = 0.15
# ------------------------------------------------------------------------------------------


def _strings(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


def content_words(words: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Distinct tokens longer than three letters that are not stop words, in first-seen order."""
    return F.array_except(F.filter(words, lambda w: F.length(w) > 3), _strings(stopwords))


def markers(text: Column, lexicon: list[str]) -> Column:
    """Lexicon phrases present between letter boundaries, in lexicon order.

    The plain substring test runs first: it is cheap and settles most phrases.
    """
    return markers_in_lower(F.lower(text), lexicon)


def markers_in_lower(lower: Column, lexicon: list[str]) -> Column:
    hits = []
    for phrase in lexicon:
        bounded = lower.rlike(f"(?<![a-z]){re.escape(phrase)}(?![a-z])")
        hits.append(F.when(F.contains(lower, F.lit(phrase)) & bounded, F.lit(phrase)))
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def specificity(text: Column, sentences: Column, cap: int = 25) -> Column:
    """Capitalised words that do not open a sentence, then years, then figures."""

    after_first = f"(?<=[{X.WS}])[^{X.WS}]*[A-Z][^{X.WS}]*"

    def capitals(sentence):
        tokens = F.regexp_extract_all(sentence, F.lit(after_first), F.lit(0))
        bare = F.transform(tokens, lambda w: F.regexp_replace(w, "[^A-Za-z'-]", ""))
        return F.filter(bare, lambda w: (F.length(w) > 2) & w.rlike("^[A-Z][a-z]"))

    names = F.flatten(F.transform(sentences, capitals))
    years = F.regexp_extract_all(text, F.lit(YEAR), F.lit(0))
    figures = F.transform(F.regexp_extract_all(text, F.lit(FIGURE), F.lit(0)), X.strip_ws)
    return F.slice(F.array_distinct(F.concat(names, years, figures)), 1, cap)


def sentence_length_stats(lengths: Column) -> tuple[Column, Column]:
    """(sum, sample standard deviation) of one row's sentence lengths."""
    n = F.size(lengths)
    total = F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, v: a + v)
    squares = F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, v: a + v.cast("bigint") * v)
    spread = (squares - total * total / n) / (n - 1)
    return total, F.when(n < 2, F.lit(0.0)).otherwise(F.sqrt(F.greatest(spread, F.lit(0.0))))


def overlap_share(prompt_words: Column, essay_words: Column) -> Column:
    size = F.size(prompt_words)
    return F.when(size > 0, F.size(F.array_intersect(prompt_words, essay_words)) / size).otherwise(F.lit(0.0))


def restates(first_words: Column, statement_words: Column) -> Column:
    echoed = F.size(F.array_intersect(first_words, statement_words))
    smaller = F.least(F.size(first_words), F.size(statement_words))
    return (F.size(first_words) >= 4) & (F.size(statement_words) > 0) & (
        F.when(smaller > 0, echoed / smaller).otherwise(F.lit(0.0)) >= 0.7
    )


def copies_prompt(essay: Column, statement: Column) -> Column:
    """The first 200 normalised characters of the essay stand in the statement.

    The first token alone must stand there too; that settles most rows without
    normalising essay or statement.
    """
    trimmed = X.strip_ws(essay)
    token = F.left(F.lower(F.regexp_extract(trimmed, f"^[^{X.WS}]+", 0)), F.lit(200))
    head = F.left(F.lower(X.squeeze_ws(trimmed)), F.lit(200))
    return (token != "") & F.contains(F.lower(statement), token) & F.contains(F.lower(X.squeeze_ws(statement)), head)


def with_signals(
    df: DataFrame,
    essay: str = "essay",
    statement: str = "statement",
    concession: list[str] = CONCESSION,
    formulaic: list[str] = FORMULAIC,
    stopwords: list[str] = STOPWORDS,
    off_topic_below: float = OFF_TOPIC_BELOW,
    out: str = "signals",
) -> DataFrame:
    """Add one struct with every signal.

    Token, sentence and content-word arrays are computed once per row in an inner
    projection; the outer one only combines them.  Only the flags, which rows are filtered
    by, stand behind a generator; so a job that reads some signals computes no other ones.
    """
    keep = [F.col(c) for c in df.columns]
    body = X.strip_ws(F.coalesce(F.col(essay), F.lit("")))
    prompt = F.coalesce(F.col(statement), F.lit(""))
    base = df.select(*keep, body.alias("_t"), prompt.alias("_s"))
    base = base.withColumns({
        "_low": F.lower("_t"),
        "_words": X.signal_words(F.col("_t")),
        "_sent": X.sentences(F.col("_t")),
        "_paras": F.size(X.paragraphs(F.col("_t"))),
        "_pc": content_words(X.signal_words(F.col("_s")), stopwords),
    })
    base = base.withColumns({
        "_n": F.size("_words"),
        "_lens": F.transform(F.col("_sent"), lambda s: F.size(X.signal_words(s))),
        "_first": content_words(X.signal_words(F.coalesce(F.get(F.col("_sent"), F.lit(0)), F.lit(""))), stopwords),
        "_overlap": overlap_share(F.col("_pc"), F.col("_words")),
    })
    n, sent_n = F.col("_n"), F.size("_sent")
    flags = F.array_compact(F.array(
        F.when(n == 0, F.lit("empty")),
        F.when((n > 0) & (n < 50), F.lit("extremely_short")),
        F.when((n >= 50) & (F.col("_overlap") < off_topic_below), F.lit("off_topic")),
        F.when((F.col("_paras") == 1) & (n > 150), F.lit("single_paragraph")),
        F.when(copies_prompt(F.col("_t"), F.col("_s")), F.lit("copies_prompt")),
    ))
    _, spread = sentence_length_stats(F.col("_lens"))
    signals = F.struct(
        n.alias("word_count"),
        F.col("_paras").alias("paragraph_count"),
        sent_n.alias("sentence_count"),
        F.when(sent_n > 0, round_up_half(n / sent_n, 1)).otherwise(F.lit(0.0)).alias("mean_sentence_words"),
        round_up_half(spread, 1).alias("sentence_length_stdev"),
        round_up_half(F.col("_overlap"), 2).alias("prompt_overlap"),
        restates(F.col("_first"), F.col("_pc")).alias("opens_by_restating_prompt"),
        markers_in_lower(F.col("_low"), concession).alias("concession_markers"),
        specificity(F.col("_t"), F.col("_sent")).alias("specificity_markers"),
        markers_in_lower(F.col("_low"), formulaic).alias("formulaic_markers"),
        F.col("_flags").alias("flags"),
    )
    return X.computed_once(base, _flags=flags).select(*keep, signals.alias(out))


def is_mechanical_zero(flags: Column) -> Column:
    return F.arrays_overlap(flags, F.array(F.lit("empty"), F.lit("copies_prompt")))


def _number(value: Column) -> Column:
    """Print without a trailing .0, as the scored prompts do."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def render_signals(sig: str = "signals") -> Column:
    """Signals as text lines for a scorer, worded as evidence."""

    def listed(field):
        items = F.col(f"{sig}.{field}")
        return F.when(F.size(items) > 0, F.array_join(items, ", ")).otherwise(F.lit("none found"))

    f = lambda name: F.col(f"{sig}.{name}")
    flags = F.when(F.size(f("flags")) > 0, F.array_join(f("flags"), ", ")).otherwise(F.lit("none"))
    return F.concat_ws(
        "\n",
        F.format_string("Length: %d words, %d paragraph(s), %d sentences.",
                        f("word_count"), f("paragraph_count"), f("sentence_count")),
        F.concat(F.lit("Sentence length: mean "), _number(f("mean_sentence_words")),
                 F.lit(" words, standard deviation "), _number(f("sentence_length_stdev")), F.lit(".")),
        F.concat(F.lit("Topical overlap with the prompt: "),
                 F.floor(f("prompt_overlap") * 100 + 0.5).cast("string"),
                 F.lit("% of prompt content words appear in the response.")),
        F.concat(F.lit("Opens by restating the prompt: "),
                 F.when(f("opens_by_restating_prompt"), "yes").otherwise("no"), F.lit(".")),
        F.concat(F.lit("Concession/counterargument markers: "), listed("concession_markers"), F.lit(".")),
        F.concat(F.lit("Proper nouns, dates and figures: "), listed("specificity_markers"), F.lit(".")),
        F.concat(F.lit("Formulaic signposting: "), listed("formulaic_markers"), F.lit(".")),
        F.concat(F.lit("Mechanical flags: "), flags, F.lit(".")),
    )
