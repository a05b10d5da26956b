"""Benchmark decontamination as a prefix-filtered set join.

An item is taken as its windows of ``window`` consecutive words (one window if it has fewer)
and a window as the set of its word shingles.  Containment is exact, so of a window's
shingles, ordered by rarity over all documents, the rarest one is the necessary prefix: a
document without it cannot hold the window.

1. One pass over the documents counts the benchmark's shingles in them.  A window with a
   shingle that no document has is dropped; the others keep their rarest shingle.  Neighbouring
   windows mostly share it, so few shingles are left.
2. A second pass emits, for each place of such a shingle, the words around it.
3. Candidates meet the windows in a join on the shingle.  The window must begin inside the
   document (positional bound) and end inside it (length bound); then its words are compared.

In both passes a bitmap of ``BITS`` bits (two megabytes, whatever the benchmark's size) drops
shingles that are surely not wanted; what passes by chance fails in the join.  Nothing else is
sent to tasks by hand, and no text is shuffled.

Defined cases: null texts and texts without words have no words, hit nothing and hold nothing;
repeated rows are judged each; repeated items count once; null item_ids are no items; an empty
benchmark leaves every document clean; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm import wordhash as H
from gradeloom.session import materialise

WINDOW = 10
SHINGLE = 5
BITS = 24

# fixed values: what separates words, and the cases of A-Z
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def plain_words(text: Column) -> Column:
    """Words of a text: lower-cased A-Z, digits and everything beyond ASCII."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(low, NOT_WORD), lambda w: w != "")


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, length, item_id): each window of each item once; ``key`` is its words."""
    words = items.where("item_id is not null").select("item_id", plain_words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    spans = F.transform(F.sequence(F.lit(1), F.greatest(F.size("ws") - window + 1, F.lit(1))), lambda i: F.slice("ws", i, window))
    each = words.select("item_id", F.explode(spans).alias("w"))
    return each.select(F.concat_ws(" ", "w").alias("key"), F.size("w").alias("length"), "item_id").distinct()


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """(key, length, token, place, k): the shingles of each different window; short ones are one shingle."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keys, lengths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: tuple[list, ...] = ([], [], [], [], [])
            for a, _, raw, off in H.pieces(batch.column(0)):
                w = H.Words(raw, off, H.NOT_ALNUM)
                for r in range(len(off) - 1):
                    own = w.hash[w.first[r]:w.first[r] + w.count[r]]
                    k = min(shingle, len(own))
                    for place, token in enumerate(H.grams(own, k).view(np.int64)):
                        for col, v in zip(out, (keys[a + r], lengths[a + r], token, place, k), strict=True):
                            col.append(v)
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["key", "length", "token", "place", "k"])
    return windows.select("key", "length").distinct().mapInArrow(
        batches, "key string, length int, token bigint, place int, k int")


def bitmap(tokens: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Bits of the tokens' low ends as bytes, at most 2**BITS bits, and the shingle sizes in use."""
    low = F.col("token").bitwiseAND((1 << BITS) - 1)
    cells = tokens.select(F.shiftright(low, 6).alias("cell"), F.expr("shiftleft(1L, cast(token & 63 as int))").alias("bit"))
    bits = np.zeros(1 << (BITS - 6), np.int64)
    for cell, word in cells.groupBy("cell").agg(F.bit_or("bit")).collect():
        bits[cell] = word
    sizes = sorted(r[0] for r in tokens.select("k").distinct().collect())
    return bits, sizes


def wanted(bits: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    low = tokens & np.uint64((1 << BITS) - 1)
    word = bits[(low >> np.uint64(6)).astype(np.int64)].view(np.uint64)
    return ((word >> (low & np.uint64(63))) & np.uint64(1)).astype(bool)


def shingle_counts(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """(token, n): places of possibly wanted shingles over all documents."""
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [np.zeros(0, np.uint64)]
            for _, _, raw, off in H.pieces(batch.column(0)):
                w = H.Words(raw, off, H.NOT_ALNUM)
                for k in sizes:
                    g, _ = H.row_grams(w, k)
                    found.append(g[wanted(held.value, g)])
            token, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])
    counted = docs.select(F.col("text").cast("string")).mapInArrow(batches, "token bigint, n bigint")
    return counted.groupBy("token").agg(F.sum("n").alias("n"))


def prefixes(shingles: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, length, token, place, k): the rarest shingle of each window that can occur at all."""
    ranked = shingles.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = F.min(F.struct("n", "token", "place", "k")).alias("p")
    return ranked.groupBy("key", "length").agg(best).where("p.n > 0").select("key", "length", "p.token", "p.place", "p.k")


def scanned(docs: DataFrame, bits: np.ndarray, sizes: list[int], window: int) -> DataFrame:
    """Per row (rid, doc_id, n_words, found): places of prefix shingles with the words around them."""
    held = docs.sparkSession.sparkContext.broadcast(bits)
    place = pa.struct([("token", pa.int64()), ("pos", pa.int64()), ("left", pa.int32()), ("around", pa.list_(pa.string()))])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 40
        for batch in it:
            n_words, found = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            for a, b, raw, off in H.pieces(batch.column(1)):
                w = H.Words(raw, off, H.NOT_ALNUM)
                n_words[a:b] = w.count
                for k in sizes:
                    g, at = H.row_grams(w, k)
                    for i in np.flatnonzero(wanted(held.value, g)):
                        p, r = int(at[i]), int(w.row[at[i]])
                        lo, hi = max(int(w.first[r]), p - window + k), min(int(w.first[r] + w.count[r]), p + window)
                        around = [w.low[w.begin[j]:w.end[j]].tobytes().decode("utf-8") for j in range(lo, hi)]
                        found[a + r].append({"token": int(g[i].view(np.int64)), "pos": p - int(w.first[r]), "left": p - lo, "around": around})
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(rid, rid + batch.num_rows)), batch.column(0), pa.array(n_words), pa.array(found, pa.list_(place))],
                ["rid", "doc_id", "n_words", "found"])
            rid += batch.num_rows
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        batches, f"rid bigint, doc_id {kind}, n_words bigint, found array<struct<token:bigint,pos:bigint,left:int,around:array<string>>>")


def occurrences(scan: DataFrame, chosen: DataFrame) -> DataFrame:
    """(rid, start, length, key): exact places of windows."""
    found = scan.select("rid", F.inline("found"))
    begin = F.col("left") - F.col("place")
    inside = (begin >= 0) & (begin + F.col("length") <= F.size("around"))
    same = F.concat_ws(" ", F.slice("around", begin + 1, F.col("length"))) == F.col("key")
    return found.join(chosen, "token").where(inside).where(same).select(
        "rid", (F.col("pos") - F.col("place")).alias("start"), "length", "key")


def hit_words(places: DataFrame) -> DataFrame:
    """(rid, n_hit): words inside any occurrence."""
    spans = places.groupBy("rid", "start").agg(F.max("length").alias("length"))
    end = F.col("start") + F.col("length")
    before = F.max(end).over(Window.partitionBy("rid").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(end - F.greatest("start", F.coalesce("_before", F.lit(0))), F.lit(0))
    return spans.withColumn("_before", before).groupBy("rid").agg(F.sum(fresh).alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    windows = materialise(item_windows(items, window), "windows")
    shingles = materialise(window_shingles(windows, shingle), "window-shingles")
    chosen = materialise(prefixes(shingles, shingle_counts(docs, *bitmap(shingles))), "prefixes")
    scan = materialise(scanned(docs, *bitmap(chosen), window), "scan")
    places = materialise(occurrences(scan, chosen), "places")
    held = places.select("rid", "key").distinct().join(windows.select("key", "item_id"), "key").select("rid", "item_id").distinct()
    names = F.array_sort(F.collect_list(F.col("item_id").cast("string")))
    per_row = held.groupBy("rid").agg(F.count("*").alias("n_items"), F.concat_ws(",", names).alias("items"))
    return (
        scan.select("rid", "doc_id", "n_words").join(hit_words(places), "rid", "left").join(per_row, "rid", "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
            F.sha2(F.encode(F.coalesce("items", F.lit("")), "UTF-8"), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
    )


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without the contaminated ones; a row with a null doc_id stays."""
    bad = contamination(docs, items, window, shingle).where("contaminated and doc_id is not null").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti")
