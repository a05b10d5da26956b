"""Rubric, anchors and topics from segmented text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import rules as R
from gradeloom.functions import text as X
from gradeloom.operators import segments
from gradeloom.operators.ordered import carry_forward
from gradeloom.schema import AXES

# ---- fixed values -------------------------------------------------------------------------
AXES_AT_1 = ["position", "development", "language", "conventions"]
GUIDE = (r"Scoring Guide ", r" Sample Responses with Reader")
LEVEL = r"Score \d\b"
CRITERIA_MARKER = "following characteristics:"
ESSAY_OR_COMMENTARY = (
    r"The following sample response received a score of \d:|Comments on sample essay receiving score of \d:"
)
TASK_MARKER = r"(?:Rater Commentary for )?Essay Response -- Score \d"
COMMENTARY_HEAD = r"^(?:Comments|Rater Commentary)"
POOL_PREAMBLE = r"as it appears in the actual test\. "
# -------------------------------------------------------------------------------------------


def _clean(docs: DataFrame) -> DataFrame:
    """Pages with folded text; a blank one adds nothing to the stream, whose pages are one space apart."""
    cleaned = docs.withColumn("text", X.fold_typography(X.drop_page_number_lines(F.col("text"))))
    return cleaned.where("text <> ''") if "part" in docs.columns else cleaned


def extract_rubric(docs: DataFrame, guide: tuple[str, str] = GUIDE, marker: str = LEVEL) -> DataFrame:
    """(doc, score, summary, axis_no, axis, descriptor), one row per criterion; score 0 has none.

    The guide stands between its two markers, over as many parts as it takes.
    """
    text = segments.between(_clean(docs), *guide, joint=" ")
    levels = segments.segment(text, marker).withColumn("score", F.regexp_extract("marker", r"\d", 0).cast("int"))
    has = F.contains("body", F.lit(CRITERIA_MARKER))
    head = F.element_at(F.split("body", CRITERIA_MARKER, 2), 1)
    items = segments.numbered_items(F.try_element_at(F.split("body", CRITERIA_MARKER, 2), F.lit(2)))
    ids = F.when(F.col("score") == 0, F.array().cast("array<string>")).when(
        F.col("score") == 1, F.array(*[F.lit(a) for a in AXES_AT_1])).otherwise(F.array(*[F.lit(a) for a in AXES]))
    criteria = F.when(has, segments.zip_criteria(ids, items))
    return levels.select(
        "doc", "score", F.when(has, X.strip_ws(F.concat(head, F.lit(CRITERIA_MARKER)))).otherwise(X.strip_ws("body")).alias("summary"),
        F.posexplode_outer(criteria).alias("axis_no", "c")).select(
        "doc", "score", "summary", "axis_no", F.col("c.axis").alias("axis"), F.col("c.descriptor").alias("descriptor"))


def rubric_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either extract that the other lacks."""
    cols = ["score", "summary", "axis", "descriptor"]
    left, right = a.select(*cols), b.select(*cols)
    return left.exceptAll(right).withColumn("only_in", F.lit("first")).unionByName(
        right.exceptAll(left).withColumn("only_in", F.lit("second")))


def extract_anchors(docs: DataFrame, marker: str = ESSAY_OR_COMMENTARY, commentary: str = COMMENTARY_HEAD,
                    prompt: str | None = None) -> DataFrame:
    """(doc, id, score, essay, commentary, statement, instruction): essays paired with their commentary."""
    text = _clean(docs)
    segs = segments.segment(text, marker, joint=" ")
    segs = segs.select(
        "doc", (F.col("part").cast("bigint") * (1 << 32) + F.col("seg_no")).alias("seg_no"),
        F.when(F.col("marker").rlike(commentary), "commentary").otherwise("essay").alias("kind"),
        F.regexp_extract("marker", r"(\d)", 1).cast("int").alias("score"), X.cut_trailer(F.col("body")).alias("body"))
    pairs = segments.pair_essays_with_commentary(segs, ["doc"])
    out = pairs.withColumn("id", F.concat(F.col("doc").cast("string"), F.lit("_score"), F.col("score").cast("string")))
    if prompt is None:
        return out
    heads = segments.first_match(text, prompt, joint=" ").withColumn("s", R.split_prompt(F.col("match"), R.OPENER_ANCHOR, squeeze=False))
    return out.join(heads.select("doc", "s.*"), "doc", "left")


def extract_topics(docs: DataFrame, opener: str = R.INSTRUCTION_OPENER, spans=R.VARIANT_SPANS, preamble: str = POOL_PREAMBLE) -> DataFrame:
    """(doc, topic_no, id, statement, instruction, variant): a statement runs from one instruction to the next."""
    text = docs.withColumn("text", X.fold_typography(F.col("text")))
    parts = text.select("doc", (F.col("part") if "part" in docs.columns else F.lit(0)).alias("part"),
                        F.posexplode(F.split("text", f"(?={opener})")).alias("i", "seg"))
    order = F.col("part").cast("bigint") * (1 << 32) + F.col("i")
    cut = parts.withColumns({"_o": order, "m": R.classify_variant_span(F.col("seg"), spans)})
    rest = F.when(F.col("m").isNotNull(), F.substring("seg", F.length("m.instruction") + 1, F.length("seg"))).otherwise(F.col("seg"))
    first = F.element_at(F.split(F.col("seg"), preamble), -1)
    cut = cut.withColumn("after", F.when(F.col("_o") == 0, first).otherwise(rest))
    placed = carry_forward(cut, ["doc"], "_o", {"before": F.col("after")}, strict=True)
    found = placed.where(F.startswith("seg", F.lit(opener)))
    statement = X.strip_ws(F.regexp_replace("before", r"^\s*\d{1,3}\s+", ""))
    return found.select(
        "doc", F.col("_o").alias("topic_no"), X.topic_id(F.col("m.variant"), statement).alias("id"), statement.alias("statement"),
        "m.instruction", "m.variant", F.when(F.col("m").isNull(), F.concat(F.lit("unclassified task instruction: "), F.left("seg", F.lit(140)))).alias("error"))
