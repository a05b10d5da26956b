"""Style brief: exemplar roles and measured length envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import text as X
from gradeloom.operators import stats


def exemplar_roles(anchors: DataFrame) -> DataFrame:
    role = F.when(F.col("score") >= 5, "target").when(F.col("score").isin(3.0, 4.0), "contrast")
    return anchors.select(F.col("id").alias("anchor_id"), "score", role.alias("role")).where("role is not null")


def confirmed_issue(essays: DataFrame) -> DataFrame:
    return essays.where((F.col("essay_type") == "issue") & (F.col("human_authenticity") == "confirmed") & F.col("essay_text").isNotNull())


def build_exemplars(essays: DataFrame, anchors: DataFrame) -> dict[str, DataFrame]:
    cohort = confirmed_issue(essays)
    structured = cohort.select(X.blank_line_paragraph_count(F.col("essay_text")).alias("paragraphs")).where("paragraphs is not null")
    return {
        "roles": exemplar_roles(anchors),
        "length_bands": stats.length_bands(anchors),
        "word_count": stats.percentiles(cohort, "word_count").withColumn("provenance", F.lit("measured")),
        "paragraph_count": stats.percentiles(structured, "paragraphs").withColumn("provenance", F.lit("measured")),
    }
