"""Corpus statistics as mergeable aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import text as X
from gradeloom.functions.numbers import safe_ratio, upper_median
from gradeloom.operators.ordered import top_per_key
from gradeloom.schema import SUBTYPES


def totals(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("essays"),
        F.count_if(F.col("data_type") == "A").alias("type_a"),
        F.count_if(F.col("data_type") == "B").alias("type_b"),
        F.sum("word_count").alias("total_words"),
        upper_median("word_count").cast("bigint").alias("median_words"),
    )


def count_by(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *cols)


def by_subtype(df: DataFrame) -> DataFrame:
    """Fixed tier order; tiers without rows do not appear."""
    place = F.array_position(F.array(*[F.lit(s) for s in SUBTYPES]), F.col("subtype")).cast("int")
    return df.groupBy("subtype").agg(F.count("*").alias("n")).withColumn("tier_order", place).orderBy("tier_order")


def score_histogram(df: DataFrame) -> DataFrame:
    return (
        df.where("score_available").groupBy("score")
        .agg(F.count("*").alias("n"), F.count_if(F.col("score_type") == "official").alias("official"))
        .orderBy("score")
    )


def authenticity_and_type(df: DataFrame) -> DataFrame:
    """Counts per authenticity level and per task type in one pass."""
    return (
        df.groupingSets([["human_authenticity"], ["essay_type"]], "human_authenticity", "essay_type")
        .agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
        .select(F.when(F.col("g") == 1, "human_authenticity").otherwise("essay_type").alias("dimension"),
                F.when(F.col("g") == 1, F.col("human_authenticity")).otherwise(F.col("essay_type")).alias("value"), "n")
    )


def by_source(df: DataFrame) -> DataFrame:
    auth = F.col("human_authenticity")
    return df.groupBy("source_name").agg(
        F.count("*").alias("n"),
        F.count_if("score_available").alias("scored"),
        F.count_if(auth == "confirmed").alias("confirmed"),
        F.count_if(auth == "likely").alias("likely"),
        F.count_if(auth == "uncertain").alias("uncertain"),
    )


def by_year(df: DataFrame) -> DataFrame:
    year = F.coalesce(F.left(F.nullif(F.col("publication_date"), F.lit("")), F.lit(4)), F.lit("(unknown)"))
    return df.groupBy(year.alias("year")).agg(F.count("*").alias("n"))


def duplicates_removed(df: DataFrame) -> DataFrame:
    return df.agg(F.sum("duplicate_count").alias("removed"), F.count("*").alias("kept"))


def breakdown(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """'value:n, ...' per key, most frequent first.  Only the value counts are gathered."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))))
    return counts.groupBy(key).agg(F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", s.v, (-s.m).cast("string"))), ", ").alias(out))


def source_report(df: DataFrame) -> DataFrame:
    base = df.groupBy("source_name").agg(F.count("*").alias("n"), F.count_if("score_available").alias("scored"))
    return (
        base.join(breakdown(df, "source_name", "score_type", "score_types"), "source_name")
        .join(breakdown(df, "source_name", "human_authenticity", "authenticity"), "source_name")
    )


def length_bands(anchors: DataFrame, score: str = "score", essay: str = "essay") -> DataFrame:
    """Word counts per whole score: n, sorted value x count list, median rounded half-even.

    The list is kept as distinct values with their counts, so it grows with the range of
    lengths and not with the number of essays.
    """
    words = anchors.select(F.col(score).cast("int").alias("score"), F.size(X.space_words(F.col(essay))).alias("words"))
    counts = words.groupBy("score", "words").agg(F.count("*").alias("n"))
    listed = counts.groupBy("score").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("words", "n"))),
        lambda s: F.concat_ws("x", s.words.cast("string"), s.n.cast("string"))), " ").alias("word_counts"))
    medians = words.groupBy("score").agg(
        F.count("*").alias("n"), F.bround(F.expr("percentile(words, 0.5)"), 0).cast("int").alias("median_words"))
    return medians.join(listed, "score")


def percentiles(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Exact inclusive percentiles, rounded half-even; state is one count per distinct value."""
    p = F.expr(f"percentile({column}, array(0.1, 0.25, 0.5, 0.75, 0.9))")
    names = ["p10", "p25", "median", "p75", "p90"]
    rounded = [F.bround(F.get(F.col("_p"), F.lit(i)), 0).cast("int").alias(n) for i, n in enumerate(names)]
    grouped = df.groupBy(*by) if by else df.groupBy()
    return grouped.agg(p.alias("_p")).select(*(by or []), *rounded)


def topic_pool_stats(topics: DataFrame) -> DataFrame:
    length = topics.select("statement", F.length("statement").alias("len"))
    return length.agg(
        F.count("*").alias("topics"),
        (F.count("*") - F.countDistinct("statement")).alias("repeated_statements"),
        F.min("len").alias("min_len"), upper_median("len").cast("int").alias("median_len"),
        F.max("len").alias("max_len"),
    )


def tier_manifest(records: DataFrame, tier: str = "label_source") -> DataFrame:
    """Per tier: rows, rows with a resolvable variant, and the score distribution as text."""
    counts = records.groupBy(tier, "true_score").agg(
        F.count("*").alias("n"), F.count("variant").alias("resolvable"))
    dist = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("true_score", "n"))),
        lambda s: F.concat_ws(":", s.true_score.cast("string"), s.n.cast("string"))), ", ")
    return counts.groupBy(tier).agg(
        F.sum("n").alias("count"), F.sum("resolvable").alias("variant_resolvable"), dist.alias("score_distribution"))


def top3_concentration(records: DataFrame, by: list[str], score: str = "true_score") -> DataFrame:
    """Share of rows at the three most frequent scores, rounded half-even to 3 digits."""
    counts = records.groupBy(*by, score).agg(F.count("*").alias("n"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    top = top_per_key(counts, by, [F.desc("n"), F.col(score)], 3).groupBy(*by).agg(F.sum("n").alias("top"))
    return top.join(total, by).select(
        *by, F.col("total").alias("count"), F.bround(F.col("top") / F.greatest("total", F.lit(1)), 3).alias("concentration_top3"))


def usage_totals(df: DataFrame) -> DataFrame:
    """Token totals and the share of input served from cache."""
    sums = df.agg(*[F.sum(c).alias(c) for c in ("input", "cached", "cache_write", "output")])
    whole = F.col("input") + F.col("cached") + F.col("cache_write")
    return sums.withColumns({"total_input": whole, "cache_hit_rate": safe_ratio(F.col("cached"), whole)})


def usage_per_item(df: DataFrame, item: str = "item_id") -> DataFrame:
    return df.groupBy(item).agg(
        *[F.sum(c).alias(c) for c in ("input", "cached", "cache_write", "output")], F.count("*").alias("calls"))


# ---- fixed values: list rates in dollars per token and cache multipliers ------------------
INPUT_RATE, OUTPUT_RATE = 3e-6, 15e-6
CACHE_WRITE_FACTOR, CACHE_READ_FACTOR = 1.25, 0.1
# -------------------------------------------------------------------------------------------


def estimated_cost(input_="input", cached="cached", cache_write="cache_write", output="output"):
    return (
        F.col(input_) * INPUT_RATE + F.col(cache_write) * INPUT_RATE * CACHE_WRITE_FACTOR
        + F.col(cached) * INPUT_RATE * CACHE_READ_FACTOR + F.col(output) * OUTPUT_RATE
    )
