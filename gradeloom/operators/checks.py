"""Data-quality rules as DataFrames of violations: an empty result passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import text as X


def violation(df: DataFrame, rule_id: str, key: Column, message: Column | str, where: Column | None = None) -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    rows = df if where is None else df.where(where)
    return rows.select(F.lit(rule_id).alias("rule_id"), key.cast("string").alias("key"), text.alias("message"))


def all_of(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def expected_counts(df: DataFrame, keys: list[str], expected: DataFrame, rule_id: str) -> DataFrame:
    """Full outer comparison of group sizes with the expected ones."""
    actual = df.groupBy(*keys).agg(F.count("*").alias("actual"))
    both = actual.join(expected, keys, "full")
    got, want = F.coalesce("actual", F.lit(0)), F.coalesce("expected", F.lit(0))
    return violation(both.where(got != want), rule_id, F.concat_ws("/", *keys),
                     F.format_string("has %d, expected %d", got, want))


def expected_values(df: DataFrame, column: str, expected: list, rule_id: str) -> DataFrame:
    """Values that are missing from, repeated in, or foreign to the expected sequence."""
    spark = df.sparkSession
    want = spark.createDataFrame([(v,) for v in expected], [column]).withColumn("expected", F.lit(1).cast("bigint"))
    return expected_counts(df, [column], want, rule_id)


def length_between(df: DataFrame, key: str, text: Column, low: int, high: int | None, rule_id: str) -> DataFrame:
    n = F.length(F.coalesce(text, F.lit("")))
    bad = (n < low) if high is None else ~n.between(low, high)
    return violation(df, rule_id, F.col(key), F.format_string("length %d out of range", n), bad)


def min_tokens(df: DataFrame, key: str, text: Column, low: int, rule_id: str) -> DataFrame:
    n = F.size(X.space_words(F.coalesce(text, F.lit(""))))
    return violation(df, rule_id, F.col(key), F.format_string("only %d words", n), n < low)


def foreign_key(df: DataFrame, column: str, ref: DataFrame, ref_column: str, rule_id: str) -> DataFrame:
    parents = ref.select(F.col(ref_column).alias(column)).distinct()
    return violation(df.join(parents, column, "left_anti"), rule_id, F.col(column), "unknown reference")


def unique(df: DataFrame, column: str, rule_id: str) -> DataFrame:
    repeated = df.groupBy(column).agg(F.count("*").alias("n")).where("n > 1")
    return violation(repeated, rule_id, F.col(column), F.format_string("occurs %d times", F.col("n")))


def head_tokens(text: Column, n: int = 10) -> Column:
    return F.array_join(F.slice(X.space_words(text), 1, n), " ")


def leaked_head(df: DataFrame, key: str, inner: str, outer: str, rule_id: str, n: int = 10) -> DataFrame:
    """Row-wise leak: the first tokens of one column occur inside another."""
    return violation(df, rule_id, F.col(key), "leaked head", F.contains(F.col(outer), head_tokens(F.col(inner), n)))


def leaked_heads_across(docs: DataFrame, doc_key: str, text: str, heads: DataFrame, head_key: str, head_text: str,
                        n: int = 10) -> DataFrame:
    """(doc, item) pairs where an item's first ``n`` tokens occur in a document.

    Items and documents meet on hashed token windows, so work follows the number of
    tokens, not documents times items.  The outer tokens of a head may sit inside longer
    words of the document, so windows are keyed on the inner tokens and every candidate
    is confirmed on the raw text.  A head of two tokens is keyed on a word's suffix and the
    next word's prefix, a head of one token on pieces of words, both of the lengths that
    such heads have.  An empty head occurs in every text, as for ``contains``.
    """
    items = heads.select(F.col(head_key), head_tokens(F.col(head_text), n).alias("head"))
    items = items.where("head is not null").withColumn("_t", F.split("head", " ")).withColumn("_m", F.size("_t") - 2)
    first, last = F.length(F.element_at("_t", 1)), F.length(F.element_at("_t", -1))
    shape = items.where("head <> ''").select(head_key, "head", "_t", "_m", F.when(F.col("_m") < 1, first).alias("_a"),
                                             F.when(F.col("_m") == 0, last).alias("_b"))
    shapes = [tuple(r) for r in shape.select("_m", "_a", "_b").distinct().collect()]  # word counts, or lengths of short heads
    sizes = sorted(m for m, _, _ in shapes if m >= 1)
    ones, twos = sorted(a for m, a, _ in shapes if m == -1), sorted((a, b) for m, a, b in shapes if m == 0)
    keyed = shape.select(head_key, "head", F.when(F.col("_m") >= 1, F.xxhash64("_m", F.array_join(
        F.when(F.col("_m") >= 1, F.expr("slice(_t, 2, greatest(_m, 1))")), " "))).when(
            F.col("_m") == 0, F.xxhash64("_a", "_b", "head")).otherwise(F.xxhash64("_a", F.lit("one"), "head")).alias("h"))
    toks = F.col("_toks")

    def windows_of(size):
        return F.when(F.size(toks) >= size + 2, F.transform(
            F.sequence(F.lit(2), F.size(toks) - size),
            lambda i: F.xxhash64(F.lit(size), F.array_join(F.slice(toks, i, size), " ")))
        ).otherwise(F.array().cast("array<bigint>"))

    def ends_of(a, b):
        pairs = F.when(F.size(toks) >= 2, F.transform(F.sequence(F.lit(1), F.size(toks) - 1), lambda i: F.struct(
            F.element_at(toks, i).alias("x"), F.element_at(toks, i + 1).alias("y")))).otherwise(F.array().cast("array<struct<x:string,y:string>>"))
        fit = F.filter(pairs, lambda p: (F.length(p["x"]) >= a) & (F.length(p["y"]) >= b))
        return F.transform(fit, lambda p: F.xxhash64(F.lit(a), F.lit(b), F.concat(
            F.right(p["x"], F.lit(a)), F.lit(" "), F.left(p["y"], F.lit(b)))))

    def pieces_of(a):
        fit = F.filter(F.array_distinct(toks), lambda t: F.length(t) >= a)
        return F.flatten(F.transform(fit, lambda t: F.transform(
            F.sequence(F.lit(1), F.length(t) - a + 1), lambda i: F.xxhash64(F.lit(a), F.lit("one"), F.substr(t, i, F.lit(a))))))

    kinds = [*[windows_of(s) for s in sizes], *[ends_of(a, b) for a, b in twos], *[pieces_of(a) for a in ones]] or [windows_of(1)]
    tokenised = docs.select(F.col(doc_key), X.space_words(F.col(text)).alias("_toks"))
    windows = tokenised.select(doc_key, F.explode(F.array_distinct(F.concat(*kinds))).alias("h"))
    candidates = windows.join(keyed, "h").select(doc_key, head_key, "head").distinct()
    confirmed = candidates.join(docs.select(doc_key, text), doc_key)
    empty = docs.where(F.col(text).isNotNull()).select(doc_key).crossJoin(items.where("head = ''").select(head_key))
    return confirmed.where(F.contains(F.col(text), F.col("head"))).select(doc_key, head_key).unionByName(empty)


def forbidden(df: DataFrame, key: str, text: Column, pattern: str, rule_id: str) -> DataFrame:
    return violation(df, rule_id, F.col(key), "forbidden text", text.rlike(pattern))


def prefix_rule(df: DataFrame, key: str, text: Column, prefix: str, required: bool, rule_id: str) -> DataFrame:
    has = F.coalesce(F.startswith(text, F.lit(prefix)), F.lit(False))
    return violation(df, rule_id, F.col(key), "prefix missing" if required else "prefix not allowed",
                     ~has if required else has)


def array_size(df: DataFrame, key: str, column: str, size: int, rule_id: str) -> DataFrame:
    n = F.when(F.col(column).isNull(), 0).otherwise(F.size(column))
    return violation(df, rule_id, F.col(key), F.format_string("has %d entries", n), n != size)


def declared(df: DataFrame, key: str, column: str, rule_id: str) -> DataFrame:
    return violation(df, rule_id, F.col(key), "not declared", F.col(column).isNull())


def score_domain(df: DataFrame, key: str, score: Column, low: float, high: float, rule_id: str) -> DataFrame:
    """Half points only."""
    good = score.between(low, high) & (score * 2 == F.floor(score * 2))
    return violation(df, rule_id, F.col(key), "score outside the domain", ~F.coalesce(good, F.lit(False)))
