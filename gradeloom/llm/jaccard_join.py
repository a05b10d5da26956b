"""Exact n-gram Jaccard join with prefix filters under several global token orders.

A document's set is its distinct word shingles.  If two sets reach the threshold, they share a
token among the first ``n - ceil(t * n) + 1`` of each *under any* global order.  Three orders
are used: (A) rarest first, ties by hash, (B) rarest first, ties by another hash, (C) by a
third hash alone.  Pairs are drawn from A's postings and must share prefix tokens under B and C
too before their texts are fetched and compared exactly.

Rarity comes from a count sketch over all documents: ``CELLS`` counters, fixed in size, summed in
blocks that stream through tasks.  It only sets the order, so counts that collide cost time and
never a link.

Only components are wanted, so a group of copies never lists its pairs:

* equal sets are one representative;
* round 1 compares the members of a posting list with its smallest member;
* round 2 compares members that still carry different labels with a member drawn anew for each
  token, so a member meets as many others as it has tokens;
* what is left, pairs of different components in one posting list, is enumerated once.

Before B and C, a pair must pass bounds.  At a pair's first common token under A nothing before
it is shared, so the pair shares at most what each side has from there on (``reach`` of a
posting); under the rarity order the edits of a near copy stand before it, and near misses fall
by arithmetic.  A later common token gives a smaller bound, but the first one is a posting of
both too.  A token that no other prefix has may stand behind another document's prefix, so it
counts for nothing by itself.  Each set also has 256 parity bits: a token flips one, so bits that
differ are at most the tokens that only one side has, and members of a hot posting list that are
unlike fall inside the join, before a row is made.  And a prefix token below the other prefix's
end that the other prefix lacks is surely missing from it.

Joins are on tokens and ids, so a hot posting list is split by adaptive execution.  Prefix tokens
are written once; texts are shuffled once, for documents that have a posting in common.

Defined cases: null or empty text, or none but white space, has an empty set and links with
nothing; fewer words than a shingle are one shingle; equal texts link; rows of one doc_id are one
node; a null doc_id links with nothing and has a null component; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm import wordhash as H
from gradeloom.llm.common import Scratch
from gradeloom.operators.components import connected_components

CELLS = 1 << 20
BLOCK = 1 << 10
PARITY = ("s0", "s1", "s2", "s3")


def row_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    w = H.Words(raw, offsets, H.SPACE)
    for first, count in zip(w.first, w.count, strict=True):
        own = w.hash[first:first + count]
        yield np.unique(H.grams(own, min(k, count))) if count else own


def _text_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for _, _, raw, off in H.pieces(column):
        yield from row_sets(raw, off, k)


def rarity_classes(docs: DataFrame, k: int) -> np.ndarray:
    """Per sketch cell twice the log2 of the documents' tokens in it, one byte each."""
    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for batch in it:
            for s in _text_sets(batch.column(0), k):
                np.add.at(cells, (s & np.uint64(CELLS - 1)).astype(np.int64), 1)
        used = np.flatnonzero(cells.reshape(-1, BLOCK).any(axis=1))
        if len(used):
            yield _blocks(used, cells.reshape(-1, BLOCK)[used])

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in it:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(data.as_py(), np.int64)
                sums[b] = sums[b] + part if b in sums else part
        if sums:
            yield _blocks(np.array(list(sums)), np.stack(list(sums.values())))
    schema = "block int, counts binary"
    parts = docs.select(F.col("text").cast("string")).mapInArrow(count, schema)
    out = np.zeros((CELLS // BLOCK, BLOCK), np.uint8)
    # the sketch has CELLS counters whatever the corpus is
    for b, data in parts.repartition("block").mapInArrow(add, schema).collect():
        out[b] = np.ceil(2 * np.log2(np.frombuffer(data, np.int64) + 1.0)).astype(np.uint8)
    return out.reshape(-1)


def _blocks(ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids.astype(np.int32)), pa.array([c.tobytes() for c in counts], pa.binary())], ["block", "counts"])


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _head(tokens: np.ndarray, key: np.ndarray, length: int) -> np.ndarray:
    return tokens if length >= len(tokens) else tokens[np.argpartition(key, length - 1)[:length]]


def prefixed(docs: DataFrame, k: int, percent: int, classes: np.ndarray) -> DataFrame:
    """(doc_id, n, k1, k2, s0..s3, a, b, c): set size, identity and parity bits, and the prefix under each order.

    ``a`` has sorted ranks (rarity, then 56 bits of hash), which also name the tokens.  ``b`` and ``c`` keep 32 bits of a token: they only filter, and a chance match is compared.
    """
    held = docs.sparkSession.sparkContext.broadcast(classes)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n, ids, parity, heads = [], [], [], ([], [], [])
            for s in _text_sets(batch.column(1), k):
                n.append(len(s))
                if not len(s):
                    ids.append((None, None))
                    parity.append(np.zeros(len(PARITY), np.int64))
                    for h in heads:
                        h.append([])
                    continue
                ids.append(tuple(np.frombuffer(blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist()))
                flips = np.bincount((H.mix(s + np.uint64(3)) >> np.uint64(56)).astype(np.int64), minlength=64 * len(PARITY))
                parity.append(np.packbits((flips & 1).astype(np.uint8)).view(np.int64))
                p = prefix_length(len(s), percent)
                rare = held.value[(s & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)
                other, third = H.mix(s + np.uint64(1)), H.mix(s + np.uint64(2))
                ranked = rare | (s >> np.uint64(8))
                heads[0].append(np.sort(_head(ranked, ranked, p)).view(np.int64))
                heads[1].append(_head(other, rare | (other >> np.uint64(8)), p).astype(np.uint32).view(np.int32))
                heads[2].append(_head(third, third, p).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array([x[0] for x in ids], pa.int64()), pa.array([x[1] for x in ids], pa.int64()),
                 *[pa.array([bits[i] for bits in parity], pa.int64()) for i in range(len(PARITY))],
                 pa.array(heads[0], pa.list_(pa.int64())), pa.array(heads[1], pa.list_(pa.int32())), pa.array(heads[2], pa.list_(pa.int32()))],
                ["doc_id", "n", "k1", "k2", *PARITY, "a", "b", "c"])
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        batches, "doc_id bigint, n bigint, k1 bigint, k2 bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint, a array<bigint>, b array<int>, c array<int>")


def _near(nx: Column, rx: Column, ny: Column, ry: Column, percent: int) -> Column:
    """The length bound: even if all that both can share is shared, the threshold is reached."""
    both = F.least(rx, ry)
    return both * 100 >= (nx + ny - both) * percent


def _alike(nx: Column, sx: list[Column], ny: Column, sy: list[Column], percent: int) -> Column:
    """The parity bound: no more bits differ than tokens may be on one side only."""
    differ = reduce(operator.add, [F.bit_count(a.bitwiseXOR(b)) for a, b in zip(sx, sy, strict=True)])
    return differ <= nx + ny - 2 * F.ceil((nx + ny) * percent / (100 + percent))


def _few_misses(ax: Column, nx: Column, ay: Column, ny: Column, percent: int) -> Column:
    """The positional bound under order A, for both sides."""
    need = F.ceil((nx + ny) * percent / (100 + percent))

    def side(own: Column, n: Column, other: Column) -> Column:
        end = F.element_at(other, -1)
        return F.size(F.array_except(F.filter(own, lambda t: t <= end), other)) <= n - need
    return side(ax, nx, ay) & side(ay, ny, ax)


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (x, y) whose sets reach the threshold."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in it:
            xs, keep = batch.column(0).to_pylist(), []
            for i, t in enumerate(_text_sets(batch.column(3), k)):
                if xs[i] != last:
                    last, last_set = xs[i], next(_text_sets(batch.column(2).slice(i, 1), k))
                both = len(np.intersect1d(last_set, t, assume_unique=True))
                keep.append(100 * both >= percent * (len(last_set) + len(t) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["x", "y"]).filter(pa.array(keep, pa.bool_()))
    with_y = pairs.join(texts.select(F.col("d").alias("y"), F.col("text").alias("ty")), "y")
    both = with_y.join(texts.select(F.col("d").alias("x"), F.col("text").alias("tx")), "x")
    return both.select("x", "y", "tx", "ty").mapInArrow(batches, "x bigint, y bigint")


def _filtered(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Pairs that pass the positional bound and share prefix tokens under the other orders too."""
    side = {s: heads.select(*[F.col(c).alias(f"{c}{s}") for c in ("d", "n", "a", "b", "c")]).withColumnRenamed(f"d{s}", s) for s in "xy"}
    return pairs.join(side["y"], "y").join(side["x"], "x").where(
        F.arrays_overlap("bx", "by") & F.arrays_overlap("cx", "cy")
        & _few_misses(F.col("ax"), F.col("nx"), F.col("ay"), F.col("ny"), percent)).select("x", "y")


def _open(live: DataFrame, labels: DataFrame | None, tables: Scratch) -> DataFrame:
    """Postings whose token still joins different components, with the label of each member."""
    if labels is None:
        return live.withColumn("label", F.col("d"))
    named = tables.put("jj-labelled", live.join(labels.select(F.col("id").alias("d"), "label"), "d", "left")
                       .withColumn("label", F.coalesce("label", "d")))
    still = named.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    open_ = tables.put("jj-open", named.join(still.select("token"), "token", "left_semi"))
    tables.drop("jj-labelled")
    return open_


def _star(open_: DataFrame, draw: bool, percent: int) -> DataFrame:
    """Each member against the smallest member of its posting list, or against one drawn per token."""
    first = F.xxhash64("d", "token") if draw else F.col("d")
    centre = open_.groupBy("token").agg(F.min(F.struct(first.alias("h"), "d", "n", "reach", "label", *PARITY)).alias("m"))
    near = _near(F.col("n"), F.col("reach"), F.col("m.n"), F.col("m.reach"), percent) & _alike(
        F.col("n"), [F.col(c) for c in PARITY], F.col("m.n"), [F.col(f"m.{c}") for c in PARITY], percent)
    met = open_.join(centre, "token").where((F.col("label") != F.col("m.label")) & near)
    return met.select(F.least("d", "m.d").alias("x"), F.greatest("d", "m.d").alias("y")).distinct()


def _rest(open_: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components in one posting list that pass the bounds, each once.

    The rows are narrow; prefixes are fetched for the pairs that are left.
    """
    cols = ("token", "d", "n", "reach", "label", *PARITY)
    x, y = (open_.select(*[F.col(c).alias(f"{c}{s}") for c in cols]) for s in "xy")
    ok = ((F.col("dx") < F.col("dy")) & (F.col("labelx") != F.col("labely"))
          & _near(F.col("nx"), F.col("reachx"), F.col("ny"), F.col("reachy"), percent)
          & _alike(F.col("nx"), [F.col(f"{c}x") for c in PARITY], F.col("ny"), [F.col(f"{c}y") for c in PARITY], percent))
    return x.join(y, (F.col("tokenx") == F.col("tokeny")) & ok).select(F.col("dx").alias("x"), F.col("dy").alias("y")).distinct()


def links(nodes: DataFrame, docs: DataFrame, k: int, percent: int, tables: Scratch) -> DataFrame:
    """(id, label) of every representative that is linked with another one.

    ``nodes`` stands on the table "jj-prefixes", which is deleted once postings and heads are written.
    """
    entries = nodes.select(F.posexplode("a").alias("at", "token"), F.col("doc_id").alias("d"))
    shared = entries.groupBy("token").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo < hi").select("token")
    postings = tables.put("jj-postings", entries.join(shared, "token", "left_semi"))
    heads = tables.put("jj-heads", nodes.select(F.col("doc_id").alias("d"), "n", *PARITY, "a", "b", "c").join(
        postings.select("d").distinct(), "d", "left_semi"))
    tables.drop("jj-prefixes")
    # at a pair's first common token, what stands before it on either side is not shared
    live = tables.put("jj-live", postings.join(heads.select("d", "n", *PARITY), "d").select(
        "token", "d", "n", *PARITY, (F.col("n") - F.col("at")).alias("reach")))
    tables.drop("jj-postings")
    texts = tables.put("jj-texts", docs.select(F.col("doc_id").cast("bigint").alias("d"), F.col("text").cast("string").alias("text"))
                       .join(heads.select("d").distinct(), "d", "left_semi"))
    found = labels = None
    for step in ("smallest", "drawn", "rest"):
        open_ = _open(live, labels, tables)
        pairs = tables.put("jj-pairs", _rest(open_, percent) if step == "rest" else _star(open_, step == "drawn", percent))
        new = tables.put(f"jj-links-{step}", verified(_filtered(pairs, heads, percent), texts, k, percent))
        found = new if found is None else found.unionByName(new)
        labels = connected_components(found, "x", "y")
    tables.drop("jj-open", "jj-pairs", "jj-heads", "jj-live", "jj-texts")
    return labels


def components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable)."""
    rows, tables = docs.select("doc_id", "text"), Scratch(docs.sparkSession)
    table = tables.put("jj-prefixes", prefixed(rows, k, percent, rarity_classes(rows, k)))
    sets = tables.put("jj-sets", table.select("doc_id", F.col("n").alias("n_shingles"), "k1", "k2"))
    real = table.where("doc_id is not null and n > 0")
    reps = tables.put("jj-reps", real.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")))
    nodes = real.join(reps, (real["k1"] == reps["k1"]) & (real["k2"] == reps["k2"]) & (real["doc_id"] == reps["rep"]), "left_semi")
    labels = links(nodes, rows.where("doc_id is not null"), k, percent, tables)
    # rows of one doc_id are one node, so their sets share a label
    one = reps.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "k1", "k2", F.coalesce("label", "rep").alias("component_id"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return sets.join(one, ["k1", "k2"], "left").select(
        F.col("doc_id").cast(kind).alias("doc_id"), "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).cast("bigint").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component, its smallest doc_id; a null doc_id stays."""
    gone = components(docs, k, percent).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
