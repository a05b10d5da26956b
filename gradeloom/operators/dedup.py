"""Exact and near duplicates, keeping the copy with the best provenance.

No step gathers a group of copies into one task: survivors come from mergeable
minima, and copies are linked to representatives instead of to each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import sketch as K
from gradeloom.functions import text as X
from gradeloom.operators.components import connected_components
from gradeloom.operators.ordered import rank_within, top_per_key
from gradeloom.schema import authenticity_rank, score_rank
from gradeloom.session import materialise

THRESHOLD = 0.80
# Signature estimates have a standard error of 0.04 at 0.8, so 0.5 is seven of them away.
PREFILTER = 0.50
FIRST_PIVOTS = 64


def survivor_rank(df_ordinal: str = "ordinal") -> Column:
    """Provenance order as one comparable struct; the ordinal settles every tie."""
    return F.struct(
        score_rank(F.col("score_type")).alias("r0"),
        authenticity_rank(F.col("human_authenticity")).alias("r1"),
        F.when(F.col("prompt_text").isNotNull() & (F.col("prompt_text") != ""), 0).otherwise(1).alias("r2"),
        (-F.coalesce(F.col("word_count"), F.lit(0))).alias("r3"),
        F.col(df_ordinal).alias("r4"),
    )


def with_key(df: DataFrame, unicode: bool = True, text_col: str = "essay_text") -> DataFrame:
    """Add the normalised key once; a table written with it spares the later steps the work."""
    return df if "text_key" in df.columns else df.withColumn("text_key", X.norm_key(F.col(text_col), unicode))


def exact_groups(df: DataFrame, unicode: bool = True) -> DataFrame:
    """(group_key, head, copies): the winning ordinal and the group size.

    The key is hashed so that long texts do not travel as shuffle keys.
    """
    keyed = with_key(df, unicode).select(F.sha2("text_key", 256).alias("group_key"), survivor_rank().alias("rank"))
    return keyed.groupBy("group_key").agg(
        F.min("rank").getField("r4").alias("head"), F.count("*").alias("copies"))


def exact_survivors(df: DataFrame, columns: list[str], unicode: bool = True) -> DataFrame:
    """Survivors with the named columns and duplicate_count, in one scan.

    The winner's columns ride along in the aggregate, so this suits a few short columns;
    whole records go through ``exact_dedup``.
    """
    keyed = with_key(df, unicode).select(
        F.sha2("text_key", 256).alias("group_key"), survivor_rank().alias("rank"), F.struct(*columns).alias("row"))
    return keyed.groupBy("group_key").agg(
        F.min_by("row", "rank").alias("row"), (F.count("*") - 1).alias("duplicate_count")).select("row.*", "duplicate_count")


def exact_dedup(df: DataFrame, unicode: bool = True) -> tuple[DataFrame, DataFrame]:
    """(survivors, links).

    ``survivors`` carries duplicate_count; ``links`` is the whole list of collapsed
    copies as rows (head, source_url), distinct, so a huge group never becomes one cell.
    """
    groups = exact_groups(df, unicode)
    survivors = df.join(
        groups.select(F.col("head").alias("ordinal"), (F.col("copies") - 1).alias("duplicate_count")), "ordinal")
    keyed = with_key(df, unicode).select("ordinal", "source_url", F.sha2("text_key", 256).alias("group_key"))
    links = (
        keyed.join(groups.where("copies > 1").select("group_key", "head"), "group_key")
        .where((F.col("ordinal") != F.col("head")) & F.col("source_url").isNotNull())
        .select("head", "source_url").distinct()
    )
    return survivors, links


def empty_key_count(df: DataFrame) -> DataFrame:
    """Rows whose key is empty (no Latin letters or digits) and so share one group."""
    return df.select(F.count_if(X.norm_key(F.col("essay_text")) == "").alias("empty_keys"))


def sketches(df: DataFrame, id_col: str, text_col: str, unicode: bool = True) -> DataFrame:
    """(id, grams, sig).  The key is written first unless the table already has it: two
    Python steps in one projection would be planned together."""
    if "text_key" in df.columns:
        keyed = df.select(F.col(id_col).alias("id"), "text_key")
    else:
        keyed = materialise(with_key(df, unicode, text_col).select(F.col(id_col).alias("id"), "text_key"), "keys")
    # Behind a generator the shingles are a plain column for the Python step, whatever is pruned later.
    grams = X.computed_once(keyed, grams=X.shingle_hashes(F.col("text_key"))).drop("text_key")
    return grams.withColumn("sig", K.minhash("grams"))


def band_members(sk: DataFrame) -> DataFrame:
    """(bucket, id) for buckets shared by at least two rows."""
    exploded = sk.select("id", F.explode(K.band_keys(F.col("sig"))).alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    return exploded.join(shared, "bucket").select("bucket", "id")


def verify_pairs(pairs: DataFrame, sk: DataFrame, verify: str, threshold: float) -> DataFrame:
    """Pairs (a, b) that reach the threshold.

    The 96-slot signatures travel first; the shingle sets only for pairs that are near.
    """
    sig = sk.select("id", "sig")
    near = (
        pairs.join(sig.withColumnsRenamed({"id": "a", "sig": "sa"}), "a")
        .join(sig.withColumnsRenamed({"id": "b", "sig": "sb"}), "b")
        .withColumn("estimate", K.jaccard_estimate(F.col("sa"), F.col("sb")))
    )
    if verify == "estimate":
        return near.where(F.col("estimate") >= threshold).select("a", "b")
    near = near.where(F.col("estimate") >= PREFILTER).select("a", "b")
    grams = sk.select("id", "grams")
    return (
        near.join(grams.withColumnsRenamed({"id": "a", "grams": "ga"}), "a")
        .join(grams.withColumnsRenamed({"id": "b", "grams": "gb"}), "b")
        .where(K.jaccard_exact(F.col("ga"), F.col("gb")) >= threshold)
        .select("a", "b")
    )


def near_duplicate_labels(
    df: DataFrame, id_col: str = "ordinal", text_col: str = "essay_text",
    verify: str = "exact", threshold: float = THRESHOLD, unicode: bool = True,
) -> DataFrame:
    """(id, label) for rows that belong to a near-duplicate cluster of two or more.

    The clusters are those of "every pair sharing a band is checked", without listing
    the pairs of a group: each bucket first compares all members with one pivot, which
    is linear and joins a group of copies at once.  A bucket stays open only where its
    members then carry different labels; there, members meet over rare shingles
    (``linked_in_buckets``), or, where signatures alone decide, over growing pivots.
    """
    sk = materialise(sketches(df, id_col, text_col, unicode), "sketch")
    members = materialise(band_members(sk), "bands")
    first = members.groupBy("bucket").agg(F.min("id").alias("a"))
    pairs = (
        members.join(first, "bucket").where("id <> a")
        .select("a", F.col("id").alias("b")).distinct()
    )
    edges = materialise(verify_pairs(pairs, sk, verify, threshold), "edges")
    labels = connected_components(edges)
    open_rows = members.join(first, "bucket").where("id <> a").select("bucket", "id")
    if verify == "exact":
        current = materialise(still_open(open_rows, labels), "open")
        found = materialise(linked_in_buckets(current, sk, threshold), "edges")
        return merge_labels(labels, found)
    pivots_per_bucket = FIRST_PIVOTS
    while True:
        current = materialise(still_open(open_rows, labels), "open")
        if current.limit(1).count() == 0:
            return labels
        sizes = current.groupBy("bucket", "label").agg(F.count("*").alias("n"))
        largest = sizes.groupBy("bucket").agg(
            F.max_by("label", F.struct("n", (-F.col("label")).alias("tie"))).alias("main"))
        outside = current.join(largest, "bucket").where("label <> main").drop("main")
        pivots = materialise(
            top_per_key(outside, ["bucket"], [F.col("id")], pivots_per_bucket)
            .select("bucket", F.col("id").alias("pid"), F.col("label").alias("plabel")), "pivots")
        pairs = (
            current.join(pivots, "bucket").where("label <> plabel")
            .select(F.least("id", "pid").alias("a"), F.greatest("id", "pid").alias("b")).distinct()
        )
        found = materialise(verify_pairs(pairs, sk, verify, threshold), "edges")
        labels = merge_labels(labels, found)
        open_rows = current.join(pivots.select("bucket", F.col("pid").alias("id")), ["bucket", "id"], "left_anti").select(
            "bucket", "id")
        pivots_per_bucket *= 4


def still_open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, id, label) of the buckets whose members carry different labels."""
    labelled = rows.join(labels, "id", "left").select("bucket", "id", F.coalesce("label", "id").alias("label"))
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
    return labelled.join(mixed, "bucket")


def prefix_pairs(current: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of one bucket and of different labels that may reach the threshold.

    Two sets that do share a shingle among the rarest n - ceil(threshold * n) + 1 of each; so the
    members of a bucket meet per such shingle, and sizes rule out more.  A shingle that many
    members hold is rare to none of them and stands in few prefixes.  Where only one label meets,
    as among the copies of one text, nothing is paired; elsewhere the members outside the largest
    label are paired with all, so copies are never paired with copies.
    """
    ids = current.select("id").distinct()
    own = grams.join(ids, "id", "left_semi").select("id", F.size("grams").alias("n"), F.explode("grams").alias("g"))
    counts = own.groupBy("g").agg(F.count("*").alias("df"))
    keep = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    ranked = own.join(counts, "g").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("s"))
    tokens = ranked.select("id", "n", F.explode(F.slice("s", F.lit(1), keep)).alias("t")).select("id", "n", F.col("t.g").alias("g"))
    posts = materialise(current.join(tokens, "id"), "postings")  # three readers below
    per = posts.groupBy("bucket", "g", "label").agg(F.count("*").alias("m")).groupBy("bucket", "g").agg(
        F.max_by("label", F.struct("m", (-F.col("label")).alias("tie"))).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    mixed = posts.join(per.drop("labels"), ["bucket", "g"])
    minor = mixed.where("label <> main").select("bucket", "g", F.col("id").alias("pid"), F.col("label").alias("plabel"), F.col("n").alias("pn"))
    near = (F.least("n", "pn") >= F.greatest("n", "pn") * threshold - 1e-9) & (F.col("label") != F.col("plabel"))
    return mixed.join(minor, ["bucket", "g"]).where(near).select(
        F.least("id", "pid").alias("a"), F.greatest("id", "pid").alias("b")).distinct()


def linked_in_buckets(current: DataFrame, sk: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of open buckets that reach the threshold."""
    return verify_pairs(prefix_pairs(current, sk.select("id", "grams"), threshold), sk, "exact", threshold)


def merge_labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Fold new edges into existing labels by contracting each cluster to its label."""
    known_a = labels.withColumnsRenamed({"id": "a", "label": "la"})
    known_b = labels.withColumnsRenamed({"id": "b", "label": "lb"})
    contracted = (
        edges.join(known_a, "a", "left").join(known_b, "b", "left")
        .select("a", "b", F.coalesce("la", "a").alias("x"), F.coalesce("lb", "b").alias("y"))
    )
    contracted = materialise(contracted, "contract")
    if contracted.where("x <> y").limit(1).count() == 0:
        return labels
    merged = connected_components(contracted, "x", "y").select(F.col("id").alias("label"), F.col("label").alias("root"))
    fresh = contracted.select(F.col("a").alias("id"), F.col("x").alias("label")).unionByName(
        contracted.select(F.col("b").alias("id"), F.col("y").alias("label"))).distinct()
    everyone = labels.unionByName(fresh).distinct()
    return materialise(
        everyone.join(merged, "label", "left").select("id", F.coalesce("root", "label").alias("label")).distinct(),
        "labels")


def cluster_survivors(survivors: DataFrame, links: DataFrame, labels: DataFrame, merge_all: bool = False):
    """(final, links): one head per cluster with summed copies.

    The head keeps its own collapsed URLs and gains the losers' direct URLs; the losers'
    own earlier lists are left out unless ``merge_all``.
    """
    clustered = survivors.join(labels.withColumnRenamed("id", "ordinal"), "ordinal", "left").withColumn(
        "cluster", F.coalesce("label", "ordinal")).drop("label")
    heads = clustered.groupBy("cluster").agg(
        F.min(survivor_rank()).getField("r4").alias("ordinal"),
        (F.sum("duplicate_count") + F.count("*") - 1).alias("total"),
    )
    final = (
        clustered.drop("cluster").join(heads, "ordinal")
        .withColumn("duplicate_count", F.col("total")).drop("total", "cluster")
    )
    head_of = heads.select("cluster", F.col("ordinal").alias("head"))
    placed = clustered.select("cluster", "ordinal", "source_url").join(head_of, "cluster")
    losers = placed.where("ordinal <> head and source_url is not null").select("head", "source_url")
    earlier = links.withColumnRenamed("head", "ordinal").join(
        placed.select("ordinal", F.col("head").alias("new_head")), "ordinal")
    if not merge_all:
        earlier = earlier.where("ordinal = new_head")
    all_links = earlier.select(F.col("new_head").alias("head"), "source_url").unionByName(losers).distinct()
    return final, all_links


def render_links(links: DataFrame, max_urls: int | None = None) -> DataFrame:
    """(head, duplicate_of_sources): the sorted list of every head as one cell.

    Only a caller that sets ``max_urls`` leaves larger groups out; their size is counted
    before anything is gathered, and all their URLs stay in ``links``.
    """
    if max_urls is None:
        return _cells(links)
    small = links.groupBy("head").agg(F.count("*").alias("n")).where(F.col("n") <= max_urls).select("head")
    return _cells(links.join(small, "head"))


def _cells(links: DataFrame) -> DataFrame:
    return links.groupBy("head").agg(
        F.array_join(F.array_sort(F.collect_list("source_url")), " | ").alias("duplicate_of_sources"))


def unique_ids(df: DataFrame, id_col: str = "essay_id", order: str = "ordinal") -> DataFrame:
    """The k-th repeat of an id gets the suffix __k."""
    numbered = rank_within(df, [id_col], order, out="_k")
    suffix = F.when(F.col("_k") > 1, F.concat(F.lit("__"), (F.col("_k") - 1).cast("string"))).otherwise(F.lit(""))
    return numbered.withColumn(id_col, F.concat(F.col(id_col), suffix)).drop("_k")


def newest_snapshot(df: DataFrame, key: str = "canonical_url", ts: str = "ts") -> DataFrame:
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), F.col(ts)).alias("r")).select(key, "r.*")


def first_accepted(df: DataFrame, accepted: Column, id_col: str = "id", order: str = "ordinal") -> DataFrame:
    """Acceptance is tested before an id counts as seen."""
    others = [c for c in df.columns if c != id_col]
    return (
        df.where(accepted).groupBy(id_col)
        .agg(F.min_by(F.struct(*others), F.col(order)).alias("r")).select(id_col, "r.*")
    )


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return df.join(seen.select(key).distinct(), key, "left_anti")
