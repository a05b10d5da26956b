"""Quality rules as a short-circuit cascade, in built-in column functions only.

A rule is a condition under which a document is rejected.  The verdict is the same in any
order, so the order is free: each rule is timed in the form in which it runs and its rejections
are counted on a sample, and rules stand by rejections per cost, best first.  In one CASE the first rule that rejects ends
the work on a document.  The sample (``SAMPLE_ROWS`` rows at most) decides nothing but the
order.

All work is inside a row: repeated five-word windows are found by sorting the window hashes of
one document, so no document's words are shuffled.  Counts are of code points.

Defined cases: null and empty texts have no words and are rejected by the base rule; repeated
rows are judged each; other columns pass through; an empty table gives no rows and the rules
keep the order they were written in.
"""

from __future__ import annotations

import math
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.common import BLANKS, bind, free_name, without

SAMPLE_ROWS = 500
SAMPLE_CHARS = 1 << 16
WINDOW = 5
MIN_WORDS = 10
# fixed values: the counted symbols
SYMBOLS = r"[#*$%&|<>]+"
TIMED_CHARS = 1 << 22
TIMES = 2
LEAST_SECONDS = 5e-3

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def words_of(text: Column) -> Column:
    """Words between the six blanks, in order."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def word_chars(text: Column) -> Column:
    return _without(F.replace(text, F.lit(" "), F.lit("")), r"[\x09-\x0D]+").cast("bigint")


def symbols(text: Column, pattern: str = SYMBOLS) -> Column:
    return (F.length(text) - _without(text, pattern)).cast("bigint")


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    with_words = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return bind(with_words, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))


def _covered(windows: Column, window: int) -> Column:
    """Words in windows that occur twice: sort (hash, place), keep those with an equal neighbour."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        n = F.size(s)

        def equal(x: Column, at: Column) -> Column:
            return F.when((at >= 0) & (at < n), F.get(s, at).getField("h") == x.getField("h")).otherwise(F.lit(False))
        return F.array_sort(F.transform(
            F.filter(s, lambda x, i: equal(x, i - 1) | equal(x, i + 1)), lambda x: x.getField("i")))

    def total(at: Column) -> Column:
        # a covered place adds the words up to the next one, five at most
        return F.aggregate(
            F.transform(at, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - x, F.lit(window)))),
            F.lit(0).cast("bigint"), lambda a, x: a + x)
    return bind(bind(placed, twice), total)


def word_measures(text: Column, window: int = WINDOW) -> Column:
    """struct(n_words, n_repeat_words, n_stutter) from one split of the text."""
    def measured(h: Column) -> Column:
        n = F.size(h)
        # the words of each window side by side; runs that end early are null there and cut off
        runs = F.slice(F.arrays_zip(*[F.slice(h, j + 1, F.greatest(n - j, F.lit(0))).alias(f"w{j}") for j in range(window)]),
                       F.lit(1), F.greatest(n - (window - 1), F.lit(0)))
        hashes = F.transform(runs, lambda r: F.xxhash64(r))
        # most documents repeat no window, and a distinct count shows that without a sort
        repeated = bind(hashes, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("bigint"))
                        .otherwise(_covered(g, window)))
        stutter = F.size(F.filter(h, lambda x, i: (i > 0) & (x == F.get(h, i - 1))))
        return F.struct(n.cast("bigint").alias("n_words"), repeated.alias("n_repeat_words"), stutter.cast("bigint").alias("n_stutter"))
    return bind(F.transform(words_of(text), lambda w: F.xxhash64(w)), measured)


def base_failed(n_words: Column, n_repeat: Column) -> Column:
    """The base rule: too few words, or more than a fifth of them in repeated windows."""
    return (n_words < MIN_WORDS) | (n_repeat * 100 > n_words * 20)


def text_rules(text: Column, chars: Column, n_symbols: Column, n_dup_lines: Column) -> dict[str, Column]:
    """The method's rules on characters and lines; every one leaves ordinary prose alone."""
    return {
        "symbols": n_symbols * 100 > chars * 6,
        "exclamations": symbols(text, "!+") * 100 > chars * 8,
        "upper_case": symbols(text, r"\p{Lu}+") * 100 > chars * 50,
        "dup_lines": (n_dup_lines * 100 > F.size(F.split(text, "\n")) * 40) & (F.size(F.split(text, "\n")) >= 4),
        "no_letters": symbols(text, r"[^\p{L}\x20\x09-\x0D]+") * 100 > chars * 60,
        "endless_word": text.rlike(r"[^\x20\x09-\x0D]{1001}"),
    }


def stutters(n_words: Column, n_stutter: Column) -> Column:
    """A third of the words repeat the word before them."""
    return n_stutter * 100 > n_words * 30


def cascade(rules: dict[str, Column]) -> Column:
    """True for a document that no rule rejects; later rules are not computed after a rejection."""
    out = None
    for rule in rules.values():
        out = F.when(rule, F.lit(False)) if out is None else out.when(rule, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def sample_of(docs: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """The first ``SAMPLE_ROWS`` texts of up to ``SAMPLE_CHARS`` characters with the given measures of ``text``.

    What the driver holds is bounded, and no more files are opened than it needs.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    made = docs.select(text).where(F.length("text") <= SAMPLE_CHARS).limit(SAMPLE_ROWS).withColumns(measures)
    return docs.sparkSession.createDataFrame(made.collect(), made.schema).coalesce(1)


def measured_order(sample: DataFrame, rules: dict[str, Column]) -> list[tuple[str, int, float]]:
    """(rule, cost class, share rejected) on a sample, best rule first.

    The sample is repeated to ``TIMED_CHARS`` characters so that a rule's own work shows beside the job's.  A
    first run warms each rule up, the least of ``TIMES`` more counts, and what a run without a rule takes is
    subtracted.  Costs differ by noise, so they are classes of powers of four of the least cost that
    can be told from nothing; equal ranks keep the order in which the rules were written.
    """
    n, chars = sample.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    if not n:
        return [(name, 0, 0.0) for name in rules]
    repeated = sample.withColumn(free_name("_r", sample.columns), F.explode(F.sequence(F.lit(1), F.lit(max(1, TIMED_CHARS // max(chars, 1))))))

    def timed(rule: Column) -> tuple[float, float]:
        job, least = repeated.agg(F.count("*"), F.count_if(rule)), None
        for _ in range(1 + TIMES):
            began = time.perf_counter()
            total, hit = job.first()
            spent = time.perf_counter() - began
            least = spent if least is None or spent < least else least
        return least, hit / total
    nothing = min(timed(F.length("text") < 0)[0] for _ in range(2))
    floor = max(nothing / 4, LEAST_SECONDS)
    out = []
    for at, (name, rule) in enumerate(rules.items()):
        spent, share = timed(rule)
        cost = max(0, round(math.log(max(spent - nothing, floor) / floor, 4)))
        out.append((-share / 4 ** cost, cost, at, name, share))
    return [(name, cost, share) for _, cost, _, name, share in sorted(out)]


def ordered(sample: DataFrame, rules: dict[str, Column]) -> dict[str, Column]:
    """The rules, best first."""
    return {name: rules[name] for name, _, _ in measured_order(sample, rules)}


def _of_text(text: Column) -> dict[str, Column]:
    return text_rules(text, word_chars(text), symbols(text), dup_lines(text))


def judged(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with the five measures, ``base_failed`` and ``kept``.

    The measures are wanted for every row, so the rules read them, when they are timed as when they
    decide; only what the measures do not cover is left to the cascade.
    """
    words, source = free_name("_m", docs.columns), F.coalesce(F.col("text").cast("string"), F.lit(""))

    def measures(text: Column) -> dict[str, Column]:
        return {words: word_measures(text), "word_chars": word_chars(text), "n_symbols": symbols(text), "n_dup_lines": dup_lines(text)}

    def rules(text: Column) -> dict[str, Column]:
        m = F.col(words)
        return {"base": base_failed(m.getField("n_words"), m.getField("n_repeat_words")),
                "stutter": stutters(m.getField("n_words"), m.getField("n_stutter")),
                **text_rules(text, F.col("word_chars"), F.col("n_symbols"), F.col("n_dup_lines"))}
    best = ordered(sample_of(docs, measures(F.col("text"))), rules(F.col("text")))
    rest = [F.col(f"`{c}`") for c in without(docs.columns, *MEASURES, "base_failed", "kept")]
    out = docs.select(*rest, *[c.alias(name) for name, c in measures(source).items()])
    out = out.withColumns({"n_words": F.col(words).getField("n_words"), "n_repeat_words": F.col(words).getField("n_repeat_words")})
    out = out.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    decide = rules(source)
    return out.withColumn("kept", cascade({name: decide[name] for name in best})).drop(words)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that no rule rejects; the rules on words share one split and stand as one."""
    def all_rules(text: Column) -> dict[str, Column]:
        by_words = bind(word_measures(text), lambda m: base_failed(m.getField("n_words"), m.getField("n_repeat_words"))
                        | stutters(m.getField("n_words"), m.getField("n_stutter")))
        return {**_of_text(text), "words": by_words}
    rules = all_rules(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.where(cascade({name: rules[name] for name in ordered(sample_of(docs, {}), all_rules(F.col("text")))}))
