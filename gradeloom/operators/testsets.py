"""Tiered review sets and the greedy spread of writing prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import rules as R
from gradeloom.functions import text as X
from gradeloom.operators.ordered import place_all, top_per_key
from gradeloom.operators.prompts import variant_templates
from gradeloom.schema import TRUST_TIERS


def review_records(essays: DataFrame, anchors: DataFrame | None = None, task: str = "issue",
                   opener: str = R.OPENER_TESTSET, rules=R.VARIANT_RULES) -> DataFrame:
    """Scored rows with their tier.  The top tier always comes from the cleaned anchors."""
    trust = F.create_map(*[F.lit(x) for s, t, _ in TRUST_TIERS for x in (s, t)])
    rows = essays.where((F.col("essay_type") == task) & F.col("score").isNotNull() & F.col("essay_text").isNotNull())
    wanted = [s for s, _, _ in TRUST_TIERS if anchors is None or s != "A1_official"]
    rows = rows.where(F.col("subtype").isin(*wanted)).withColumn("_p", R.split_prompt(F.col("prompt_text"), opener))
    corpus = rows.select(
        F.col("essay_id").alias("id"), F.col("essay_text").alias("essay"), "_p.statement", "_p.instruction",
        R.classify_variant(F.coalesce("_p.instruction", F.lit("")), rules).alias("variant"),
        F.col("score").alias("true_score"), F.col("subtype").alias("label_source"),
        trust[F.col("subtype")].alias("trust"), "source_name", "word_count")
    if anchors is None:
        return corpus
    official = anchors.select(
        "id", "essay", F.col("prompt_statement").alias("statement"), F.col("prompt_instruction").alias("instruction"),
        F.coalesce(R.classify_variant(F.col("prompt_instruction"), rules), F.lit("statement")).alias("variant"),
        F.col("score").alias("true_score"), F.lit("A1_official").alias("label_source"),
        F.lit("ground_truth").alias("trust"), F.lit("official responses").alias("source_name"),
        F.size(X.testset_words(F.col("essay"))).alias("word_count"))
    return official.unionByName(corpus)


def out_of_scope(essays: DataFrame, task: str = "argument", subtype: str = "B1_machine_scored") -> DataFrame:
    return essays.where(
        (F.col("essay_type") == task) & (F.col("subtype") == subtype) & F.col("score").isNotNull()
        & F.col("essay_text").isNotNull()
    ).select(F.col("essay_id").alias("id"), F.col("essay_text").alias("essay"), "prompt_text",
             F.col("score").alias("true_score"), F.col("subtype").alias("label_source"),
             F.lit("not_a_label").alias("trust"), "source_name", "word_count")


def in_tier_order(records: DataFrame) -> DataFrame:
    return records.orderBy("label_source", F.desc("true_score"), "id")


def tier_places(records: DataFrame) -> DataFrame:
    """``place`` of every record in its tier: best score first, then id."""
    return place_all(records, [F.desc("true_score"), F.col("id")], ["label_source"])


def anchored_prompts(prompts: DataFrame, pool: DataFrame, rules=R.VARIANT_RULES) -> DataFrame:
    """Prompts with officially scored responses; their moves come from the last topic of the variant."""
    variant = F.coalesce(R.classify_variant(F.col("instruction"), rules), F.lit("statement"))
    moves = variant_templates(pool, keep="last").drop("instruction")
    return (
        prompts.withColumn("variant", variant).join(moves, "variant")
        .select(F.concat(F.lit("anchored_"), F.col("id")).alias("id"), "statement", "instruction", "variant",
                "variant_summary", "required_moves", F.lit(True).alias("anchored"), F.col("id").alias("anchor_group"))
    )


def spread_prompts(pool: DataFrame, anchored: DataFrame, variants: list[str], per_variant: int = 4,
                   domains=R.DOMAIN_RULES) -> DataFrame:
    """Per variant: anchored prompts, then one topic per domain, then topics in pool order.

    ``variants`` is the order in which variants choose; a statement is used once over all
    of them.  Other variants can take at most ``per_variant`` statements each, so the
    first ``per_variant * len(variants)`` topics of every (variant, domain) decide the
    result.  Only those few rows reach the driver, where the variants take turns.
    """
    depth = per_variant * len(variants)
    first = pool.join(anchored.select("statement"), "statement", "left_anti").groupBy("variant", "statement").agg(
        F.min("ordinal").alias("ordinal"))
    ranked = top_per_key(first.withColumn("domain", R.domain_of(F.col("statement"), domains)),
                         ["variant", "domain"], [F.col("ordinal")], depth)
    candidates = ranked.orderBy("ordinal").collect()
    have = {r["variant"]: r["count"] for r in anchored.groupBy("variant").count().collect()}
    used: set[str] = set()
    chosen: list[tuple[int, str]] = []
    for variant in variants:
        free = [r for r in candidates if r["variant"] == variant and r["statement"] not in used]
        opener_of = {r["domain"]: r["ordinal"] for r in reversed(free)}
        by_turn = sorted(free, key=lambda r: (opener_of[r["domain"]] != r["ordinal"], r["ordinal"]))
        for row in by_turn[: max(0, per_variant - have.get(variant, 0))]:
            used.add(row["statement"])
            chosen.append((row["ordinal"], variant))
    picked = F.lit(False)
    for ordinal, variant in chosen:
        picked = picked | ((F.col("ordinal") == ordinal) & (F.col("variant") == variant))
    pooled = pool.where(picked).select(
        "id", "statement", "instruction", "variant", "variant_summary", "required_moves",
        F.lit(False).alias("anchored"), F.lit(None).cast("string").alias("anchor_group"))
    return anchored.unionByName(pooled).withColumn("domain", R.domain_of(F.col("statement"), domains))


def in_prompt_order(selected: DataFrame) -> DataFrame:
    return selected.orderBy("variant", F.desc("anchored"), "id")


def prompt_manifest(selected: DataFrame) -> DataFrame:
    """Counts per variant, per domain and of anchored prompts in one pass."""
    return (
        selected.groupingSets([["variant"], ["domain"], []], "variant", "domain")
        .agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if("anchored").alias("anchored"))
        .select(F.when(F.col("g") == 1, "variant").when(F.col("g") == 2, "domain").otherwise("all").alias("dimension"),
                F.coalesce(F.when(F.col("g") == 1, F.col("variant")).when(F.col("g") == 2, F.col("domain")), F.lit("")).alias("value"),
                "n", "anchored")
    )
