"""Text normalisation, tokenisers and splitters as Column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space beyond the ASCII set that Python and JavaScript also strip.
WS = r"\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS_CHARS = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]))
_NON_ASCII = r"[^\x00-\x7f]"

# ---- fixed values: the four tokenisers ---------------------------------------------------
WORD_COUNT_TOKEN = "[A-Za-z0-9']+"
SIGNAL_TOKEN = "[a-z][a-z'-]*"
TESTSET_TOKEN = "[A-Za-z][A-Za-z'-]*"
# ------------------------------------------------------------------------------------------


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def _only_where_needed(udf, text: Column) -> Column:
    """ASCII text is already normal, so only the other rows carry their text to Python."""
    return F.coalesce(udf(F.when(text.rlike(_NON_ASCII), text)), text)


def strip_ws(text: Column) -> Column:
    """Native two-sided trim; much cheaper than an anchored pattern on long texts."""
    return F.trim(text, F.lit(WS_CHARS))


def squeeze_ws(text: Column) -> Column:
    return F.regexp_replace(text, f"[{WS}]+", " ")


def clean_text(text: Column, unicode: bool = True) -> Column:
    """Compatibility form, straight quotes and dashes, LF line ends, trimmed lines."""
    t = F.coalesce(text, F.lit(""))
    if unicode:
        t = _only_where_needed(_nfkc, t)
    t = F.translate(t, "\u2019\u2018\u201c\u201d\u2013", "''\"\"-")
    t = F.replace(t, F.lit("\u2014"), F.lit("--"))
    t = F.regexp_replace(t, "\r\n?", "\n")
    t = F.regexp_replace(t, "[ \t\u00a0]+", " ")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    edge = f"[{WS}&&[^\n]]+"
    t = F.regexp_replace(t, f"(?md)^{edge}|{edge}$", "")
    return strip_ws(t)


def _decomposed() -> tuple[str, list[str]]:
    """The characters whose compatibility form (NFKD) holds one of a-z0-9, and what a key keeps of each form."""
    kept = {}
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x110000)):
        form = re.sub("[^a-z0-9]+", " ", unicodedata.normalize("NFKD", chr(code)))
        if form != " ":
            kept[chr(code)] = form
    return "".join(kept), list(kept.values())


_PARTED, _FORMS = _decomposed()


def _with_forms(text: Column) -> Column:
    """``text`` with each of its characters in ``_PARTED`` replaced by its form."""
    found = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(_NON_ASCII), F.lit(0))), lambda c: F.instr(F.lit(_PARTED), c) > 0)
    forms = F.split(F.lit(",".join(_FORMS)), ",")
    return F.aggregate(found, text, lambda t, c: F.replace(t, c, F.element_at(forms, F.instr(F.lit(_PARTED), c))))


def norm_key(text: Column, unicode: bool = True) -> Column:
    """Exact-duplicate key.  Decomposed accents become spaces, so an accented letter ends a token.

    A character's form does not hang on its neighbours but for the order of marks, which a key drops;
    so the forms that leave a letter or digit are put in, and all else beyond a-z0-9 is a space.
    """
    t = F.lower(F.coalesce(text, F.lit("")))
    if unicode:
        # bound, so that no branch lowers the text again
        t = let(t, lambda low: F.when(F.octet_length(low) > F.length(low), _with_forms(low)).otherwise(low))
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_COUNT_TOKEN))


def signal_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(SIGNAL_TOKEN), F.lit(0))


def testset_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TESTSET_TOKEN), F.lit(0))


def space_words(text: Column) -> Column:
    """White-space tokens; empty text has none."""
    return F.filter(F.split(strip_ws(text), f"[{WS}]+"), lambda w: w != "")


def essay_slug_id(prefix: str, slug: Column, keep: int = 70) -> Column:
    """Readable id: cleaned slug cut to ``keep`` plus a hash of the whole slug."""
    clean = F.regexp_replace(F.lower(slug), "[^a-z0-9]+", "_")
    clean = F.regexp_replace(clean, "^_+|_+$", "")
    return F.concat_ws("_", F.lit(prefix), F.left(clean, F.lit(keep)), F.left(F.sha1(slug), F.lit(8)))


def topic_id(variant: Column, statement: Column) -> Column:
    return F.concat(F.lit("issue_"), F.left(F.sha1(F.concat_ws("\n", variant, statement)), F.lit(10)))


def fold_typography(text: Column) -> Column:
    """Segmented-document normalisation: fold typographic characters, then squeeze."""
    t = F.translate(text, "\u2018\u2019\u201c\u201d\u2013\u00a0\uf0a7\u2022", "''\"\"- ")
    t = F.replace(t, F.lit("\u2014"), F.lit("--"))
    t = F.replace(t, F.lit("\u2026"), F.lit("..."))
    return strip_ws(squeeze_ws(t))


# ---- fixed value: a line that holds nothing but a page number ----------------------------
PAGE_NUMBER_LINE = r"^\s*(?:-\s*)?\d{1,3}(?:\s*-)?\s*$"
# ------------------------------------------------------------------------------------------


def drop_page_number_lines(text: Column) -> Column:
    lines = F.split(text, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]")
    return F.array_join(F.filter(lines, lambda x: ~x.rlike(PAGE_NUMBER_LINE)), "\n")


def first_sentences(text: Column, count: int) -> Column:
    parts = F.split(text, f"(?<=\\.)[{WS}]+")
    return strip_ws(F.array_join(F.slice(parts, 1, count), " "))


# ---- fixed values: header and footer lines of segmented booklets -------------------------
BOOKLET_NOISE = [
    r"^\s*-\s*\d+\s*-\s*$",
    r"^\s*\d{1,2}\s*$",
    r"(?i)GRE\s*General\s*$",
    r"^\[This footer should NOT be printed\.\]",
    r"(?i)^LT\d+-",
    r"^\s*$",
]
TRAILERS = [
    r"Copyright\s*.?\s*\d{4} by ETS\b",
    r"End of The Graduate Record Examinations\b",
    r"NO TEST MATERIAL ON THIS PAGE",
]
# ------------------------------------------------------------------------------------------


def strip_noise(block: Column, noise: list[str] = BOOKLET_NOISE) -> Column:
    """Drop furniture lines and rejoin wrapped lines into running text."""
    lines = F.split(block, "\n")

    def is_noise(line):
        hit = F.lit(False)
        for rx in noise:
            hit = hit | line.rlike(rx)
        return hit

    kept = F.transform(F.filter(lines, lambda x: ~is_noise(x)), strip_ws)
    return clean_text(squeeze_ws(F.array_join(kept, " ")))


def cut_trailer(text: Column, trailers: list[str] = TRAILERS) -> Column:
    """Everything from the first trailer phrase on is dropped."""
    return strip_ws(F.regexp_replace(text, "(?s)\\s*(?:" + "|".join(trailers) + ").*$", ""))


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, f"(?<=[.!?])[\"')\\]]*[{WS}]+"), strip_ws)
    return F.filter(parts, lambda s: s.rlike("[A-Za-z]"))


def _non_blank(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip_ws), lambda p: p != "")


def paragraphs(text: Column) -> Column:
    """Blank-line paragraphs; when there is only one, single line breaks count instead."""
    def by_line(blank):
        return let(_non_blank(F.split(text, "\n")), lambda lines: F.when(F.size(lines) > 1, lines).otherwise(blank))

    return let(_non_blank(F.split(text, f"\n[{WS}]*\n")), lambda blank: F.when(F.size(blank) > 1, blank).otherwise(by_line(blank)))


def blank_line_paragraph_count(text: Column) -> Column:
    """NULL for text without a line break: its structure is unknown."""
    return F.when(F.contains(text, F.lit("\n")), F.size(_non_blank(F.split(text, f"\n[{WS}]*\n"))))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Catalyst may inline a projected column into a lambda, where it would be computed per
    element; a value bound as a lambda argument is computed once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed_once(df: DataFrame, **exprs: Column) -> DataFrame:
    """Add costly columns behind a generator.

    A filter on a projected column is pushed down with the whole expression, which then
    runs once in the filter and again in the projection.  A one-element generator keeps
    the filter above it, so each expression runs once per row.
    """
    rest = [c for c in df.columns if c not in exprs]
    return df.select(*rest, F.inline(F.array(F.struct(*[e.alias(n) for n, e in exprs.items()]))))


def _key_tokens(key: Column) -> Column:
    return F.filter(F.split(key, " "), lambda w: w != "")


def _grams(toks: Column, k: int, make) -> Column:
    last = F.greatest(F.size(toks) - (k - 1), F.lit(1))
    starts = F.when(F.size(toks) > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: make(F.array_join(F.slice(toks, i, k), " "))))


def shingle_hashes(key: Column, k: int = 5) -> Column:
    """Distinct 64-bit hashes of the k-token shingles of a normalised key.

    Fewer than k tokens make one shingle; an empty key makes none.
    """
    return let(_key_tokens(key), lambda toks: _grams(toks, k, F.xxhash64))


def shingles(key: Column, k: int = 5) -> Column:
    return let(_key_tokens(key), lambda toks: _grams(toks, k, lambda g: g))
