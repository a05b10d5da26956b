"""Corpus build: filter, exact duplicates, near duplicates, labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import rules as R
from gradeloom.operators import dedup, quality, stats
from gradeloom.operators.labels import label
from gradeloom.session import materialise


@dataclass
class Corpus:
    """The labelled records and everything that was collapsed into them."""

    records: DataFrame
    links: DataFrame
    drops: DataFrame


def build_corpus(staged: DataFrame, tells: str = R.GENERATED_TEXT_TELLS, verify: str = "exact",
                 near: bool = True, unicode: bool = True, max_cell_urls: int | None = None) -> Corpus:
    """``staged`` needs the essay columns and ``ordinal``.

    The filtered records and their keys are written once.  Every decision (copies, heads, ids,
    address lists) is taken on narrow rows, with the key as a digest; whole records are shuffled
    once, when they are joined with what was decided, and keys once more for the sketches.
    """
    kept = materialise(dedup.with_key(quality.quality_filter(staged, tells), unicode), "kept")
    narrow = kept.select(
        "ordinal", "essay_id", "score_type", "human_authenticity", F.left("prompt_text", F.lit(1)).alias("prompt_text"), "word_count",
        "source_url", F.sha2("text_key", 256).alias("text_key"))
    survivors, links = dedup.exact_dedup(narrow, unicode)
    if near:
        survivors, links = materialise(survivors, "exact"), materialise(links, "links")
        keys = kept.select("ordinal", "text_key").join(survivors.select("ordinal"), "ordinal", "left_semi")
        labels = dedup.near_duplicate_labels(keys, verify=verify, unicode=unicode)
        survivors, links = dedup.cluster_survivors(survivors, links, labels)
        links = materialise(links, "links")
    cells = dedup.render_links(links, max_cell_urls).withColumnRenamed("head", "ordinal")
    decided = dedup.unique_ids(survivors).select("ordinal", "essay_id", "duplicate_count").join(cells, "ordinal", "left")
    labelled = label(kept.drop("text_key", "essay_id", "duplicate_count").join(decided, "ordinal"))
    return Corpus(labelled, links, quality.drop_counts(staged, tells))


def statistics(records: DataFrame) -> dict[str, DataFrame]:
    return {
        "totals": stats.totals(records),
        "score_types": stats.count_by(records, "score_type"),
        "subtypes": stats.by_subtype(records),
        "scores": stats.score_histogram(records),
        "authenticity_and_type": stats.authenticity_and_type(records),
        "sources": stats.by_source(records),
        "years": stats.by_year(records),
        "duplicates": stats.duplicates_removed(records),
        "source_report": stats.source_report(records),
    }


def flagship(staged: DataFrame, unicode: bool = True) -> DataFrame:
    """Per source: records kept, scored, confirmed, and copies collapsed, after exact dedup."""
    needed = ["source_name", "score_available", "score_type", "human_authenticity"]
    survivors = dedup.exact_survivors(quality.quality_filter(staged), needed, unicode)
    human = F.col("score_type").isin("official", "teacher_rated", "self_reported", "third_party_rated")
    priority = F.when(F.col("score_type") == "official", 1).when(human, 2).when(
        F.col("human_authenticity").isin("confirmed", "likely"), 3).otherwise(4)
    return survivors.groupBy("source_name").agg(
        F.count("*").alias("kept"), F.count_if("score_available").alias("scored"),
        F.count_if(F.col("human_authenticity") == "confirmed").alias("confirmed"),
        F.sum("duplicate_count").alias("collapsed"), F.min(priority).alias("best_priority"))
