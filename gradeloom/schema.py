"""Explicit schemas and the small label dimensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, D, B, I, L = T.StringType(), T.DoubleType(), T.BooleanType(), T.IntegerType(), T.LongType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


ESSAY = _struct(
    ("essay_id", S), ("essay_text", S), ("essay_type", S), ("prompt_text", S), ("prompt_category", S),
    ("score", D), ("score_available", B), ("score_type", S), ("score_scale", S), ("human_authenticity", S),
    ("exam_or_practice", S), ("author_username", S), ("source_name", S), ("source_url", S),
    ("publication_date", S), ("evidence_for_score", S), ("evidence_for_human_authorship", S), ("notes", S),
    ("word_count", I), ("collected_at", T.DateType()),
)
DERIVED = _struct(
    ("data_type", S), ("subtype", S), ("priority", I), ("duplicate_count", L),
    ("duplicate_of_sources", S), ("text_sha1", S),
)
# Staged JSON keeps scores as text because a blank means "no score".
STAGE_JSON = T.StructType(
    [T.StructField(f.name, S if f.name in ("score", "collected_at") else f.dataType, True) for f in ESSAY.fields]
)
POST = _struct(
    ("id", S), ("subreddit", S), ("author", S), ("title", S), ("selftext", S), ("created_utc", L),
    ("permalink", S), ("flair", S), ("query", S),
)
COMMENT = _struct(("author", S), ("body", S), ("score", L), ("created_utc", L))
COMMENT_THREAD = _struct(("link", S), ("comments", T.ArrayType(COMMENT)))
FORUM_THREAD = _struct(("t", S), ("u", S), ("b", T.ArrayType(S)), ("us", T.ArrayType(S)), ("d", S))
PAGE = _struct(("url", S), ("status", I), ("fetched_at", S), ("body", S))
SNAPSHOT = _struct(("url", S), ("ts", S))
CRITERION = _struct(("axis", S), ("descriptor", S))
RUBRIC = _struct(
    ("source", S), ("task", S), ("scale", S), ("note", S),
    ("axes", T.ArrayType(_struct(("id", S), ("name", S), ("note", S)))),
    ("levels", T.ArrayType(_struct(("score", I), ("summary", S), ("criteria", T.ArrayType(CRITERION))))),
)
ANCHOR = _struct(
    ("id", S), ("task", S), ("score", D), ("score_type", S), ("prompt_statement", S),
    ("prompt_instruction", S), ("essay", S), ("rater_commentary", S), ("source_pdf", S),
)
ANCHOR_DOC = _struct(
    ("source", S), ("count", I),
    ("prompts", T.ArrayType(_struct(("id", S), ("statement", S), ("instruction", S), ("ets_strategies", S)))),
    ("anchors", T.ArrayType(ANCHOR)),
)
TOPIC = _struct(
    ("id", S), ("statement", S), ("instruction", S), ("variant", S), ("variant_summary", S),
    ("required_moves", T.ArrayType(S)),
)
TOPIC_DOC = _struct(
    ("source", S), ("count", I), ("variant_counts", T.MapType(S, I)), ("topics", T.ArrayType(TOPIC)),
)
STYLE_DOC = _struct(
    ("task", S), ("note", S),
    ("exemplars", T.ArrayType(_struct(("anchor_id", S), ("score", D), ("role", S)))),
    ("contrasts", T.ArrayType(_struct(("anchor_id", S), ("score", D), ("role", S)))),
    ("official_length_by_score", _struct(
        ("provenance", S), ("basis", S),
        ("bands", T.ArrayType(_struct(("score", I), ("n", I), ("word_counts", T.ArrayType(I)), ("median_words", I)))),
    )),
    ("human_corpus", _struct(
        ("provenance", S), ("basis", S), ("caveat", S),
        ("word_count", T.MapType(S, D)), ("paragraph_count", T.MapType(S, D)),
    )),
    ("anti_patterns", _struct(
        ("provenance", S), ("status", S),
        ("avoid", T.ArrayType(_struct(("pattern", S), ("why", S)))), ("prefer", T.ArrayType(S)),
    )),
)
PREDICTION = _struct(
    ("id", S), ("trueScore", D), ("predictedScore", D), ("labelSource", S), ("samples", T.ArrayType(D)),
)
METRICS = _struct(
    ("n", L), ("bias", D), ("meanAbsoluteError", D), ("agreementWithinHalf", D), ("agreementWithinOne", D),
    ("exactAgreement", D), ("quadraticWeightedKappa", D), ("meanSampleSpread", D),
    ("worstMisses", T.ArrayType(_struct(("id", S), ("trueScore", D), ("predictedScore", D), ("error", D)))),
)
RUN_USAGE = _struct(
    ("input", L), ("cached", L), ("cacheWrite", L), ("output", L), ("totalInput", L), ("cacheHitRate", D),
)
EVAL_RUN = _struct(
    ("provider", S), ("model", S),
    ("metrics", _struct(("all", METRICS), ("official", METRICS), ("teacher", METRICS))),
    ("ladders", T.ArrayType(_struct(
        ("name", S), ("correctlyOrdered", B), ("pairwiseAccuracy", D),
        ("scores", T.ArrayType(_struct(("trueScore", D), ("predictedScore", D)))),
    ))),
    ("usage", RUN_USAGE), ("predictions", T.ArrayType(PREDICTION)),
    ("failures", T.ArrayType(_struct(("id", S), ("error", S)))),
)

# ---- fixed values: label vocabularies and their ranks -----------------------------------
SCORE_TYPES = ["official", "teacher_rated", "self_reported", "third_party_rated", "estimated", "none"]
AUTHENTICITY = ["confirmed", "likely", "uncertain"]
SUBTYPES = ["A1_official", "A2_teacher_rated", "A3_community_rated", "B1_machine_scored", "B2_unscored"]
SUBTYPE_OF = {
    "official": "A1_official",
    "teacher_rated": "A2_teacher_rated",
    "self_reported": "A2_teacher_rated",
    "third_party_rated": "A3_community_rated",
    "estimated": "B1_machine_scored",
    "none": "B2_unscored",
}
VARIANTS = ["claim_and_reason", "claim_challenge", "recommendation", "two_views", "policy", "statement"]
AXES = ["position", "development", "organization", "language", "conventions"]
TRUST_TIERS = [
    ("A1_official", "ground_truth", "tier1_official"),
    ("A2_teacher_rated", "strong", "tier2_teacher_rated"),
    ("A3_community_rated", "weak", "tier3_community_rated"),
    ("B1_machine_scored", "not_a_label", "tier4_machine_scored"),
]
# -----------------------------------------------------------------------------------------


def score_rank(score_type: Column) -> Column:
    """Position in the provenance order; unknown or missing counts as unscored."""
    return _position(score_type, SCORE_TYPES, 5)


def authenticity_rank(auth: Column) -> Column:
    return _position(auth, AUTHENTICITY, 3)


def _position(value: Column, order: list[str], default: int) -> Column:
    found = F.array_position(F.array(*[F.lit(x) for x in order]), value) - 1
    return F.when(F.coalesce(found, F.lit(-1)) >= 0, found).otherwise(F.lit(default)).cast("int")


def nulls_for_blank(df):
    """Text columns carry real NULLs inside the engine."""
    return df.select(*[
        F.when(F.trim(F.col(f.name)) != "", F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType)
        else F.col(f.name)
        for f in df.schema.fields
    ])


def to_reference_blank(df):
    """CSV exports carry an empty string where the engine has NULL."""
    return df.select(*[
        F.coalesce(F.col(f.name).cast("string"), F.lit("")).alias(f.name) for f in df.schema.fields
    ])
