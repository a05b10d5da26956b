"""Knowledge-base checks as one DataFrame of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.operators import checks as C

# ---- fixed values: expected shapes --------------------------------------------------------
LEVELS = [6, 5, 4, 3, 2, 1, 0]
CRITERIA_PER_LEVEL = {6: 5, 5: 5, 4: 5, 3: 5, 2: 5, 1: 4}
ANCHORS_PER_SCORE = {6.0: 3, 5.0: 3, 4.0: 3, 3.0: 3, 2.0: 3, 1.0: 3}
TOPICS_PER_VARIANT = {
    "statement": 53, "claim_challenge": 26, "claim_and_reason": 25, "recommendation": 23, "two_views": 20, "policy": 11,
}
BOOKLET_TRAILERS = r"NO TEST MATERIAL|Copyright|End of The Graduate"
OPENER = "Write a response in which"
LEAKED_COMMENTARY = r"(?i)this (?:outstanding )?response (?:presents|demonstrates|earns)"
# -------------------------------------------------------------------------------------------


def _expected(df: DataFrame, column: str, counts: dict) -> DataFrame:
    return df.sparkSession.createDataFrame([(k, v) for k, v in counts.items()], [column, "expected"]).withColumn(
        column, F.col(column).cast(df.schema[column].dataType))


def validate_rubric(criteria: DataFrame, axes: DataFrame) -> DataFrame:
    rows = criteria.where("axis is not null")
    return C.all_of(
        C.expected_values(criteria.select("score").distinct(), "score", LEVELS, "rubric_levels"),
        C.expected_counts(rows, ["score"], _expected(rows, "score", CRITERIA_PER_LEVEL), "criteria_per_level"),
        C.length_between(criteria, "score", F.col("summary"), 1, None, "level_summary"),
        C.foreign_key(rows, "axis", axes, "id", "criterion_axis"),
        C.length_between(rows, "score", F.col("descriptor"), 21, None, "descriptor_length"),
    )


def validate_anchors(anchors: DataFrame, per_score: dict = ANCHORS_PER_SCORE) -> DataFrame:
    return C.all_of(
        C.expected_counts(anchors, ["score"], _expected(anchors, "score", per_score), "anchors_per_score"),
        C.length_between(anchors, "id", F.col("essay"), 1, None, "anchor_essay"),
        C.min_tokens(anchors, "id", F.col("rater_commentary"), 80, "commentary_length"),
        C.length_between(anchors, "id", F.col("prompt_statement"), 1, None, "anchor_statement"),
        C.length_between(anchors, "id", F.col("prompt_instruction"), 1, None, "anchor_instruction"),
        C.leaked_head(anchors, "id", "rater_commentary", "essay", "commentary_leak"),
        C.forbidden(anchors, "id", F.concat_ws("\n", "essay", "rater_commentary"), BOOKLET_TRAILERS, "booklet_trailer"),
    )


def validate_topics(topics: DataFrame, per_variant: dict = TOPICS_PER_VARIANT) -> DataFrame:
    return C.all_of(
        C.unique(topics, "id", "topic_id"),
        C.expected_counts(topics, ["variant"], _expected(topics, "variant", per_variant), "topics_per_variant"),
        C.length_between(topics, "id", F.col("statement"), 50, 700, "statement_length"),
        C.prefix_rule(topics, "id", F.col("instruction"), OPENER, True, "instruction_opener"),
        C.prefix_rule(topics, "id", F.col("statement"), "Write a response", False, "statement_opener"),
        C.array_size(topics, "id", "required_moves", 3, "required_moves"),
    )


def validate_exemplars(exemplars: DataFrame, anchors: DataFrame) -> DataFrame:
    return C.foreign_key(exemplars, "anchor_id", anchors, "id", "exemplar_anchor")


def validate_style(style: DataFrame) -> DataFrame:
    parts = [style.select(F.lit(p).alias("part"), F.col(f"{p}.provenance").alias("provenance"))
             for p in ("official_length_by_score", "human_corpus", "anti_patterns")]
    rows = C.all_of(*parts)
    return C.all_of(
        C.declared(rows, "part", "provenance", "provenance"),
        C.violation(rows.where("part = 'anti_patterns'"), "authored", F.col("part"), "must be labelled as authored",
                    F.col("provenance") != "authored"),
    )


def validate_gold(gold: DataFrame, leak: str = LEAKED_COMMENTARY) -> DataFrame:
    return C.all_of(
        C.score_domain(gold, "id", F.col("true_score"), 0, 6, "gold_score"),
        C.forbidden(gold, "id", F.col("essay"), leak, "gold_leak"),
        C.length_between(gold, "id", F.col("essay"), 21, None, "gold_essay"),
        C.length_between(gold, "id", F.col("statement"), 21, None, "gold_statement"),
    )
