"""Marker segmentation and section state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.functions import text as X
from gradeloom.operators.ordered import carry_forward, rank_within, running_total
from gradeloom.session import materialise

PART_PAGES = 1000
LONGEST_MARKER = 1 << 12


def assemble_documents(pages: DataFrame, doc: str = "doc", page: str = "page_no", text: str = "text",
                       part_pages: int = PART_PAGES) -> DataFrame:
    """(doc, part, text): page texts joined in order by newlines.

    A document longer than ``part_pages`` pages becomes several rows, so no group gathers
    more than that many pages; ``segment`` reads the parts as one stream.
    """
    part = F.floor(F.col(page) / part_pages).cast("int").alias("part")
    listed = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return pages.groupBy(doc, part).agg(F.array_join(F.transform(listed, lambda s: s.t), "\n").alias("text"))


def segment(docs: DataFrame, marker: str, doc: str = "doc", joint: str = "\n") -> DataFrame:
    """(doc, part, seg_no, marker, body): each marker's text runs to the next marker or the end.

    Documents in parts are read as one stream, ``joint`` between two parts (``segment_pages``): the
    result does not depend on where they were cut, ``seg_no`` counts over the document and ``part``
    is 0.  Text before the first marker belongs to none.
    """
    if "part" in docs.columns:
        return segment_pages(docs, marker, doc, "part", "text", joint).select(
            doc, F.lit(0).alias("part"), F.col("seg_no").cast("int").alias("seg_no"), "marker", "body")
    marks = F.regexp_extract_all("text", F.lit("(" + marker + ")"), F.lit(1))
    base = docs.select(doc, F.lit(0).alias("part"), marks.alias("_m"), F.split("text", marker).alias("_b"))
    rows = base.select(doc, "part", F.posexplode(F.arrays_zip(
        F.concat(F.array(F.lit(None).cast("string")), F.col("_m")).alias("marker"), F.col("_b").alias("body"))).alias("seg_no", "s"))
    return rows.select(doc, "part", "seg_no", F.col("s.marker").alias("marker"), F.col("s.body").alias("body")).where("marker is not null")


def pieces_of(pages: DataFrame, doc: str, page: str, text: str, joint: str, chars: int) -> DataFrame:
    """(doc, piece, text, before): the stream of pages in pieces of about ``chars``, with what stands before each.

    A piece takes the pages that start in its stretch of ``chars`` characters, so it is as long as
    that and one page, whatever the pages are.  Two pieces that follow each other hold more than
    ``chars`` characters, so the ends of two pieces give the last ``chars`` before a third.
    """
    p = pages.select(F.col(doc).alias("_doc"), F.col(page).cast("bigint").alias("_page"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    at = running_total(p, ["_doc"], "_page", F.length("_t") + len(joint), "_at").withColumn("_slot", F.floor(F.col("_at") / chars))
    listed = F.array_sort(F.collect_list(F.struct(F.col("_page").alias("p"), F.col("_t").alias("t"))))
    pieces = at.groupBy("_doc", "_slot").agg(F.array_join(F.transform(listed, lambda s: s.t), joint).alias("text"))
    # ends alone are ordered by document
    order = Window.partitionBy("_doc").orderBy("_slot")
    ends = pieces.select("_doc", "_slot", F.right("text", F.lit(chars)).alias("_end"))
    both = F.concat_ws(joint, F.lag("_end", 2).over(order), F.lag("_end", 1).over(order))
    known = ends.select("_doc", "_slot", F.row_number().over(order).cast("bigint").alias("piece"), F.when(
        F.lag("_end", 1).over(order).isNotNull(), F.right(both, F.lit(chars))).alias("before"))
    return pieces.join(known, ["_doc", "_slot"]).select(F.col("_doc").alias(doc), "piece", "text", "before")


def segment_pages(pages: DataFrame, marker: str, doc: str = "doc", page: str = "page_no", text: str = "text",
                  joint: str = "\n", longest: int = LONGEST_MARKER) -> DataFrame:
    """(doc, seg_no, marker, body) over the stream of pages, wherever markers and bodies cross their seams.

    The pages of a document, joined by the single character ``joint``, are one stream.  Each piece of
    it is searched together with the end of what stands before it: a marker that ends in the piece is
    its own, also one that starts before it, and takes its head away from the pieces there.  The
    marker in force is carried on, and the bodies of one marker are joined.  Markers have at most
    ``longest`` characters, and none starts inside another one.
    """
    cut = materialise(pieces_of(pages, doc, page, text, joint, 2 * longest), "pieces")
    lead = F.length("before") + len(joint)
    w = cut.select(doc, "piece", F.coalesce(F.length("before"), F.lit(0)).alias("_len"), F.coalesce(lead, F.lit(0)).alias("_off"),
                   F.when(F.col("before").isNull(), F.col("text")).otherwise(F.concat("before", F.lit(joint), "text")).alias("_w"))
    marks = F.regexp_extract_all("_w", F.lit("(" + marker + ")"), F.lit(1))
    rows = w.select(doc, "piece", "_len", "_off", F.posexplode(F.arrays_zip(
        F.concat(F.array(F.lit(None).cast("string")), marks).alias("marker"), F.split("_w", marker).alias("body"))).alias("_i", "_s"))
    rows = rows.select(doc, "piece", "_len", "_off", "_i", F.col("_s.marker").alias("marker"), F.col("_s.body").alias("body"))
    inside = Window.partitionBy(doc, "piece").orderBy("_i")
    size = F.length(F.coalesce("marker", F.lit(""))) + F.length("body")
    rows = rows.withColumn("_start", F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("_end", F.col("_start") + F.length(F.coalesce("marker", F.lit(""))))
    rows = rows.withColumn("_next", F.lead("_start").over(inside))
    # own: a marker that ends in the piece; the row before the first own one holds the head of the piece
    own = F.col("marker").isNotNull() & (F.col("_end") > F.col("_len")) & (F.col("_start") >= F.col("_len") - longest)
    head = ~own & (F.coalesce("_next", F.col("_off")) >= F.col("_off")) & (F.col("_end") <= F.col("_off"))
    mine = rows.withColumn("_own", own).where(own | head).select(
        doc, "piece", "_i", "_own", F.when(F.col("_own"), F.col("marker")).alias("marker"), (F.col("_start") - F.col("_len")).alias("_rel"),
        F.when(F.col("_own"), F.col("body")).otherwise(F.substring(F.col("body"), F.col("_off") - F.col("_end") + 1, F.length("body"))).alias("body"))
    mine = materialise(mine, "segments")
    # what a marker over a seam takes: so many characters from the end of the stream before its piece
    taken = mine.where("_own AND _rel < 0").select(doc, "piece", (-F.col("_rel")).alias("_cut"))
    sizes = cut.select(doc, "piece", F.length("text").alias("_size")).join(taken, [doc, "piece"], "left")
    after = Window.partitionBy(doc).orderBy("piece")
    first, second = F.lead("_cut", 1).over(after), F.lead("_cut", 2).over(after) - F.lead("_size", 1).over(after) - len(joint)
    gone = F.greatest(F.coalesce(first, F.lit(0)), F.coalesce(second, F.lit(0)))
    placed = mine.join(sizes.select(doc, "piece", (F.col("_size") - gone).alias("_limit"), (gone > 0).alias("_eaten")), [doc, "piece"])
    # places inside the piece: a head starts at 0, an own row where its marker starts
    at = F.when(F.col("_own"), F.col("_rel") - len(joint) * (F.col("piece") > 1).cast("int")).otherwise(F.lit(0))
    body_at = F.when(F.col("_own"), at + F.length("marker")).otherwise(F.lit(0))
    stay = ~F.col("_eaten") | F.when(F.col("_own"), at < F.col("_limit")).otherwise(F.col("_limit") >= 0)
    placed = placed.where(stay).withColumn("body", F.when(
        F.col("_eaten"), F.left("body", F.greatest(F.lit(0), F.col("_limit") - body_at))).otherwise(F.col("body")))
    placed = placed.withColumn("_o", F.col("piece") * (1 << 32) + F.col("_i"))
    numbered = running_total(placed, [doc], "_o", F.col("_own").cast("bigint"), "seg_no", 1 << 40).withColumn(
        "seg_no", F.col("seg_no") + F.col("_own").cast("bigint"))
    return numbered.where("seg_no > 0").groupBy(doc, "seg_no").agg(
        F.max("marker").alias("marker"), F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("_o", "body"))), lambda s: s["body"]), joint).alias("body"))


def first_match(docs: DataFrame, pattern: str, doc: str = "doc", joint: str = "\n", longest: int = LONGEST_MARKER) -> DataFrame:
    """(doc, match): group 1 of the first place where ``pattern`` (of at most ``longest`` characters) matches the stream."""
    parted = docs if "part" in docs.columns else docs.withColumn("part", F.lit(0))
    cut = pieces_of(parted, doc, "part", "text", joint, 2 * longest)
    found = cut.select(doc, "piece", F.regexp_extract(F.concat_ws(joint, "before", "text"), pattern, 1).alias("match")).where("match <> ''")
    return found.groupBy(doc).agg(F.min_by("match", "piece").alias("match"))


def between(docs: DataFrame, first: str, last: str, doc: str = "doc", joint: str = "\n") -> DataFrame:
    """(doc, text) between the first marker ``first`` and the first marker ``last`` after it; documents without both have no row."""
    segs = segment(docs, f"{first}|{last}", doc, joint)
    opens = segs.where(F.col("marker").rlike(f"^(?:{first})$")).groupBy(doc).agg(F.min("seg_no").alias("_a"))
    closes = segs.where(F.col("marker").rlike(f"^(?:{last})$")).join(opens, doc).where("seg_no > _a").groupBy(doc, "_a").agg(F.min("seg_no").alias("_z"))
    text = F.when(F.col("seg_no") > F.col("_a"), F.concat("marker", "body")).otherwise(F.col("body"))
    return segs.join(closes, doc).where("seg_no >= _a AND seg_no < _z").groupBy(doc).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("seg_no", text.alias("t")))), lambda s: s["t"]), "").alias("text"))


def pair_essays_with_commentary(segments: DataFrame, keys: list[str], order: str = "seg_no") -> DataFrame:
    """Per (doc, score): the first essay and the last commentary; an essay without one keeps ''."""
    is_essay = F.col("kind") == "essay"
    return (
        segments.groupBy(*keys, "score").agg(
            F.min_by("body", F.when(is_essay, F.col(order))).alias("essay"),
            F.max_by("body", F.when(~is_essay, F.col(order))).alias("commentary"),
            F.count_if(is_essay).alias("essays"))
        .where("essays > 0").drop("essays")
        .withColumn("commentary", F.coalesce("commentary", F.lit("")))
    )


def zip_criteria(axis_ids: Column, criteria: Column) -> Column:
    """Positional pairs, cut to the shorter list."""
    n = F.least(F.size(axis_ids), F.size(criteria))
    return F.zip_with(F.slice(axis_ids, F.lit(1), n), F.slice(criteria, F.lit(1), n),
                      lambda a, d: F.struct(a.alias("axis"), d.alias("descriptor")))


def numbered_items(text: Column) -> Column:
    """Texts of '1. ... 2. ...' items."""
    return F.transform(F.filter(F.split(text, r"(?:^|\s)\d\.\s"), lambda _, i: i > 0), X.strip_ws)


def section_records(blocks: DataFrame, doc: str = "doc", pos: str = "pos", min_words: int = 100) -> DataFrame:
    """One record per analysis block that closes a pending essay.

    ``blocks`` has kind in (section, prompt, instructions, essay, analysis, other).  The
    prompt, instructions and section are the latest ones as of the analysis; the essay is
    the latest one after the previous analysis, emitted when it is long enough.
    """
    kind, text = F.col("kind"), F.col("text")
    is_analysis = kind == "analysis"
    state = carry_forward(blocks, [doc], pos, {
        "prompt": F.when(kind == "prompt", text),
        "instructions": F.when(kind == "instructions", text),
        "section": F.when(kind == "section", F.col("title") if "title" in blocks.columns else text),
        "_essay": F.when(kind == "essay", F.struct(F.col(pos).alias("at"), text.alias("body"))),
        "_closed": F.when(is_analysis, F.col(pos)),
    }, strict=True)
    pending = state.where(
        is_analysis & F.col("_essay").isNotNull()
        & (F.col("_closed").isNull() | (F.col("_essay.at") > F.col("_closed")))
        & (F.coalesce(F.col("_essay.body"), F.lit("")) != "")
        & (X.word_count(F.col("_essay.body")) >= min_words)
    ).select(doc, pos, F.col("_essay.body").alias("essay"), "prompt", "instructions", "section",
             F.col("text").alias("analysis"))
    return rank_within(pending, [doc], pos, out="n")


def block_kind(title: Column) -> Column:
    """Role of a heading on a scored-samples page."""
    low = F.lower(title)
    return (
        F.when(F.startswith(low, F.lit("prompt")) & ~F.contains(low, F.lit("essay prompt")), "prompt")
        .when(F.startswith(low, F.lit("instruction")), "instructions")
        .when(F.contains(low, F.lit("student essay")) | (low == "essay"), "essay")
        .when(F.contains(low, F.lit("analysis")), "analysis")
        .when(low.rlike(r"^((gre .*)?(issue|argument)?\s*essay prompt \d|prompt \d)"), "section")
        .otherwise("other")
    )
