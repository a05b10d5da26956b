"""License scan by diagonal voting.

Rolling hashes of all word k-grams of the documents meet the templates' k-grams in a join.  A
match of document word ``pos`` with template word ``at`` votes for the diagonal ``pos - at``;
votes are added up per (document, template, diagonal), neighbouring diagonals (a few words
inserted or left out) are merged, and a merged span is verified: its matched words, compared as
words in the join, must cover ``MIN_SHARE`` of the template.

The templates are a fixed list, so sending them to every task is safe whatever the corpus is.
A bitmap drops k-grams that are surely in no template before the join.  Texts are not shuffled;
votes are grouped by document.

Defined cases: null and empty texts have no words and no labels; repeated rows are scanned each;
ties between spans change nothing, as only labels and the best share are given; other columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.llm import wordhash as H
from gradeloom.llm.decontaminate import BITS, scanned
from gradeloom.session import materialise

K = 3
GAP = 3
MIN_SHARE = 0.75

# fixed values: phrases whose every place counts, with their labels
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

# fixed values: notices of public licenses, with their labels
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
                   "with the license"),
    ("gpl", "this work is licensed under the gnu general public license version"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
            "license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
]


def _hashes(text: str, k: int) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return H.grams(H.Words(data, np.array([0, len(data)]), H.NOT_ALNUM).hash, k)


def template_grams(phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> list[tuple]:
    """(token, gram, k, template, label, at, words, base) of every template k-gram."""
    rows = []
    for t, (label, text) in enumerate([*phrases, *notices]):
        words, base = text.split(), t < len(phrases)
        k = len(words) if base else min(K, len(words))
        for at, token in enumerate(_hashes(text, k).view(np.int64)):
            rows.append((int(token), " ".join(words[at:at + k]), k, t, label, at, len(words), base))
    return rows


def _bitmap(rows: list[tuple]) -> np.ndarray:
    bits = np.zeros(1 << (BITS - 6), np.uint64)
    for r in rows:
        low = r[0] & ((1 << BITS) - 1)
        bits[low >> 6] |= np.uint64(1) << np.uint64(low & 63)
    return bits.view(np.int64)


def matches(spark: SparkSession, scan: DataFrame, rows: list[tuple]) -> DataFrame:
    """(rid, pos, k, template, label, at, words, base) of every k-gram that is in a template."""
    templates = spark.createDataFrame(
        rows, "token bigint, gram string, k int, template int, label string, at int, words int, base boolean")
    found = scan.select("rid", F.inline("found"))
    same = F.concat_ws(" ", F.slice("around", F.col("left") + 1, F.col("k"))) == F.col("gram")
    return found.join(F.broadcast(templates), "token").where(same).drop("token", "gram", "left", "around")


def spans(met: DataFrame) -> DataFrame:
    """(rid, label, share, first, last): verified spans of notices."""
    by_diagonal = met.where("not base").groupBy("rid", "template", "label", "words", "k", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("ats"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    order = Window.partitionBy("rid", "template").orderBy("diagonal")
    begins = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > GAP).cast("int"), F.lit(1))
    merged = by_diagonal.withColumn("_new", begins).withColumn("_group", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    each = merged.groupBy("rid", "template", "label", "words", "k", "_group").agg(
        F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.min("first").alias("first"), F.max("last").alias("last"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + F.col("k") - 1)))))
    share = covered / F.col("words")
    return each.withColumn("share", share).where(F.col("share") >= MIN_SHARE).select(
        "rid", "label", "share", "first", (F.col("last") + F.col("k")).alias("last"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, places of the phrases, their labels, all labels, score."""
    spark, rows = docs.sparkSession, template_grams()
    scan = materialise(scanned(docs, _bitmap(rows), sorted({r[2] for r in rows}), K), "license-scan")
    met = materialise(matches(spark, scan, rows), "license-matches")
    base = met.where("base").groupBy("rid").agg(
        F.count("*").alias("n_base"), F.min("pos").alias("first_word"), F.max("pos").alias("last_word"),
        F.collect_set("label").alias("base_set"))
    own = spans(met).groupBy("rid").agg(F.collect_set("label").alias("own_set"), F.max("share").alias("share"))
    none = F.array().cast("array<string>")
    b, o = F.coalesce("base_set", none), F.coalesce("own_set", none)
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return scan.select("rid", "doc_id", "n_words").join(base, "rid", "left").join(own, "rid", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        F.col("first_word").cast("bigint"), F.col("last_word").cast("bigint"),
        F.concat_ws(",", F.array_sort(b)).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_union(b, o))).alias("labels"), score.alias("score"))
