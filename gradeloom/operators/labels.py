"""Provenance labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.schema import SUBTYPE_OF


def subtype_of(score_type: Column) -> Column:
    arms = F.create_map(*[F.lit(x) for pair in SUBTYPE_OF.items() for x in pair])
    return F.coalesce(F.try_element_at(arms, F.coalesce(score_type, F.lit("none"))), F.lit("B2_unscored"))


def label(df: DataFrame) -> DataFrame:
    """subtype, data_type, priority and text hash.  A six-row lookup is a literal map, not a join."""
    st, auth = F.col("score_type"), F.col("human_authenticity")
    human_score = F.coalesce(
        st.isin("official", "teacher_rated", "self_reported", "third_party_rated"), F.lit(False))
    return df.withColumns({
        "subtype": subtype_of(st),
        "data_type": F.when(human_score, "A").otherwise("B"),
        "priority": F.when(st == "official", 1).when(human_score, 2)
        .when(auth.isin("confirmed", "likely"), 3).otherwise(4),
        "text_sha1": F.sha1(F.col("essay_text")),
    })


def with_record_defaults(df: DataFrame) -> DataFrame:
    """A record without a score is marked unscored and, unless told otherwise, of type 'none'."""
    has = F.col("score").isNotNull()
    stated = F.nullif(F.col("score_type"), F.lit(""))
    return df.withColumns({
        "score_available": has,
        "score_type": F.when(has, stated).otherwise(F.coalesce(stated, F.lit("none"))),
    })
