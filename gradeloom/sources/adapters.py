"""Given tables to domain schemas.  Derived columns are arithmetic on ids, so SQL can repeat them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import text as X
from gradeloom.operators.ordered import rank_within
from gradeloom.schema import AUTHENTICITY, SCORE_TYPES, VARIANTS

ESSAY_TYPES = ["issue", "argument", "unknown"]
MOVES = ["State a position.", "Consider when it holds.", "Consider when it does not."]


TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table.

    Text work is bound by CPU, and a small file arrives as one split.  Only when a text
    table has fewer splits than the session has cores is it spread over them; a large
    table has more splits than that and is read as it lies.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXT_TABLES and cores > 1 and df.rdd.getNumPartitions() * 2 <= cores:
        return df.repartition(cores)
    return df


def pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def with_statement(docs: DataFrame, spark: SparkSession, sf_dir: str, out: str = "statement", idle: int = 0) -> DataFrame:
    """``docs`` with the benchmark text assigned to each: item rank = doc_id modulo the number of items.

    All items take part, however many there are; ``idle`` slots beyond them assign nothing.
    """
    b = table(spark, sf_dir, "benchmark").where("item_id is not null")
    slots = rank_within(b, [], "item_id").select((F.col("rn") - 1).alias("_slot"), F.col("text").alias(out))
    n = F.nullif(b.agg(F.count("*") + idle).scalar(), F.lit(0))
    return docs.join(slots, F.col("doc_id") % n == F.col("_slot"), "left").drop("_slot")


def essays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Essay records; ``ordinal`` is the ingest order."""
    d, doc = table(spark, sf_dir, "documents"), F.col("doc_id")
    score_type = pick(doc % 6, SCORE_TYPES)
    score = F.when(doc % 6 != 5, (doc % 13) / 2.0)
    return with_statement(d, spark, sf_dir, "prompt_text").select(
        doc.alias("ordinal"),
        F.concat(F.lit("doc_"), doc.cast("string")).alias("essay_id"),
        F.col("text").alias("essay_text"),
        pick(doc % 3, ESSAY_TYPES).alias("essay_type"),
        "prompt_text",
        score.alias("score"), score.isNotNull().alias("score_available"),
        score_type.alias("score_type"),
        pick(doc % 3, AUTHENTICITY).alias("human_authenticity"),
        F.col("source").alias("source_name"),
        F.concat(F.lit("u/"), doc.cast("string")).alias("source_url"),
        F.when(doc % 7 != 0, F.date_add(F.lit("2022-01-01").cast("date"), doc.cast("int")).cast("string")).alias("publication_date"),
        X.word_count(F.col("text")).alias("word_count"),
    )


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt topics; every eighth statement also stands under the next variant."""
    b, i = table(spark, sf_dir, "benchmark"), F.col("item_id")
    copies = F.explode(F.when(i % 8 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    rows = b.select("item_id", F.col("text").alias("statement"), copies)
    variant = pick((i + F.col("copy")) % 6, VARIANTS)
    return rows.select(
        (i * 2 + F.col("copy")).alias("ordinal"), X.topic_id(variant, F.col("statement")).alias("id"), "statement",
        F.concat(F.lit("Write a response in which you treat "), variant, F.lit(".")).alias("instruction"),
        variant.alias("variant"), F.concat(F.lit("about "), variant).alias("variant_summary"),
        F.array(*[F.lit(m) for m in MOVES]).alias("required_moves"))


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l, doc = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("doc_id")
    score = (doc % 6 + 1).cast("double")
    return d.join(l, "doc_id").select(
        doc.alias("ordinal"), F.concat(F.col("source"), F.lit("_"), doc.cast("string")).alias("id"), score.alias("score"),
        F.col("source").alias("group"), F.col("text").alias("essay"),
        F.concat(F.lit("Statement of "), F.col("source"), F.lit(" for discussion.")).alias("prompt_statement"),
        F.lit("Write a response in which you discuss this.").alias("prompt_instruction"),
        F.concat(F.lit("Rated "), score.cast("string")).alias("rater_commentary"), F.lit("documents").alias("source_pdf"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l, doc = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("doc_id")
    p = ((doc * 7 + F.col("n_chars")) % 13) / 2.0
    return d.select("doc_id", "n_chars", "source").join(l, "doc_id").select(
        doc.alias("ordinal"), F.concat(F.col("source"), F.lit("_score"), (doc % 10).cast("string")).alias("id"),
        F.concat(F.lit("doc_"), doc.cast("string")).alias("item_id"),
        ((doc % 13) / 2.0).alias("true_score"), p.alias("predicted_score"),
        F.when(F.col("quality") == 1, "official").otherwise("teacher_rated").alias("label_source"),
        F.array(p, F.least(p + 0.5, F.lit(6.0)), F.greatest(p - 0.5, F.lit(0.0))).alias("samples"))


def thread_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per forum post: (thread_id, pos, username, body)."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("thread_id"), F.col("turn").alias("pos"), F.col("role").alias("username"), F.col("text").alias("body"))


def openings_and_replies(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Opening post = first user post; replies = everything after it."""
    opening = posts.where("username = 'user'").groupBy("thread_id").agg(
        F.min("pos").alias("open_pos"), F.min_by("body", "pos").alias("body"))
    replies = posts.join(opening.select("thread_id", "open_pos"), "thread_id").where("pos > open_pos").drop("open_pos")
    return opening, replies


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("link"), F.col("turn").alias("pos"), F.col("role").alias("author"),
                    F.col("text").alias("body"), ((F.col("conv_id") * 31 + F.col("turn") * 7) % 11).alias("score"))


def section_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "system", "section").when(F.col("role") == "user", "essay").otherwise("analysis")
    return c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), kind.alias("kind"), F.col("text"))


def cached_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", "url", F.when(F.col("page_id") % 10 == 0, 404).otherwise(200).alias("status"),
                    F.col("page_id").alias("ts"), F.col("html").alias("body"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("item_id"), F.col("n_chars").alias("input"), (F.col("n_chars") * 3).alias("cached"),
                    (F.col("doc_id") % 100).alias("cache_write"), F.floor(F.col("n_chars") / 4).alias("output"))
