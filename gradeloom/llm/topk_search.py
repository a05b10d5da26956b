"""Exact top-k inner products: columnar branch and bound over vertical blocks.

Vectors become integers, floor(64 * c), and are written as vertical blocks: ``BLOCK_ROWS`` rows
cut into groups of ``GROUP_DIMS`` dimensions, each group one array with its dimensions side by
side.  A query adds up its products group by group.  After each group the score of a candidate
is at most its sum so far plus (query mass left) * (candidate mass left), by Cauchy and Schwarz;
candidates below the query's k-th best are compacted away, first as whole columns, then, once
few pairs are left, pair by pair.  Groups come by falling mass of the queries at hand, so the
masses left shrink fast.  All bounds are rounded up, so the result is exact.

Queries and rows are dealt into cells of bounded size, and a task gets one cell of each: neither
side is ever whole anywhere.  A first round searches one cell of rows for every query; its k-th
best score is a floor from which all later cells start.  Each cell passes on at most k rows a
query, and a window limited before its shuffle takes the k best of them.

Defined cases: rows with a null id, and vectors that are null or hold null or non-finite
entries, take no part.  Shorter vectors count as filled up with zeros.  Repeated rows are
candidates each; a query id with several rows asks once, with the smallest of its vectors, and
rows of its own id are never its candidates.  Entries beyond 2**62 are cut to that; scores
beyond a long are cut to the ends of its range.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import Scratch
from gradeloom.llm.vectors import chunks, matrix, narrow, usable

BLOCK_ROWS = 2048
GROUP_DIMS = 8
QUERY_ROWS = 256  # queries that go through a block together
QUERY_CELL = 1 << 12
ROW_CELL = 1 << 13
SPARSE = 0.04  # share of pairs alive from which on pairs are followed one by one
SLACK = 0.5  # scores are whole numbers; covers the rounding of the square roots
LOW, HIGH = -(1 << 63), (1 << 63) - 1

BLOCK = "ids binary, code string, parts array<binary>"
FOUND = "query_id bigint, vec_id bigint, score bigint"


class Block:
    """Rows in vertical layout: ids and one (dimensions x rows) array per group."""

    def __init__(self, ids: bytes, code: str, parts: list[bytes]):
        self.ids = np.frombuffer(ids, np.int64)
        self.parts = [np.frombuffer(p, np.dtype(code)).reshape(-1, len(self.ids)) for p in parts]
        self.top = max((int(np.abs(p.astype(np.float64)).max(initial=0)) for p in self.parts), default=0)
        self.mass = [(p.astype(np.float64) ** 2).sum(axis=0) for p in self.parts]


def _cut(rows: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(it, rows):
            x = narrow(matrix(batch.column(1)))
            parts = [np.ascontiguousarray(x[:, i:i + GROUP_DIMS].T).tobytes() for i in range(0, x.shape[1], GROUP_DIMS)]
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids]), pa.array([x.dtype.str]), pa.array([parts], pa.list_(pa.binary()))], ["ids", "code", "parts"])
    return batches


class Best:
    """The k best candidates of each query so far, and the score that a new one has to reach."""

    def __init__(self, n: int, k: int, floor: np.ndarray, kind: type):
        self.n, self.k, self.floor, self.kind = n, k, floor, kind
        self.query, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)
        self.needs = floor.copy()

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(query):
            return
        q, i, s = np.concatenate([self.query, query]), np.concatenate([self.id, ids]), np.concatenate([self.score, score.astype(self.kind)])
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        first = np.searchsorted(q, np.arange(self.n))
        place = np.arange(len(q)) - first[q]
        keep = place < self.k
        full = place == self.k - 1
        self.needs[q[full]] = np.maximum(self.needs[q[full]], s[full].astype(float))
        self.query, self.id, self.score = q[keep], i[keep], s[keep]


def _ceiling(sums: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """At least the largest score that these sums can still come to, rounding included."""
    most = sums.astype(float) + reach * (1 + 1e-12) + SLACK
    return most if sums.dtype != object else most + 1e-12 * np.abs(sums.astype(float))


def _scan(x: Block, queries: Block, lo: int, hi: int, best: Best, exact: type) -> None:
    """All rows of ``x`` for the queries ``lo`` to ``hi``."""
    shared = min(len(x.parts), len(queries.parts))
    left_q = sum((m[lo:hi] for m in queries.mass[:shared]), np.zeros(hi - lo))
    left_x = sum(x.mass[:shared], np.zeros(len(x.ids)))
    order = sorted(range(shared), key=lambda g: -queries.mass[g][lo:hi].sum())
    cols = np.arange(len(x.ids))
    sums = np.zeros((hi - lo, len(cols)), exact)
    alive = queries.ids[lo:hi, None] != x.ids[None, :]
    pairs = None
    for g in order:
        q, c = queries.parts[g][:, lo:hi], x.parts[g]
        dims = min(len(q), len(c))
        q, c = q[:dims].astype(exact), c[:dims]
        left_q = np.maximum(left_q - queries.mass[g][lo:hi], 0)
        left_x = np.maximum(left_x - x.mass[g], 0)
        if pairs is None:
            sums += q.T @ (c[:, cols] if len(cols) < len(x.ids) else c).astype(exact)
            reach = np.sqrt(left_q)[:, None] * np.sqrt(left_x[cols])[None, :]
            alive &= _ceiling(sums, reach) >= best.needs[lo:hi, None]
            wanted = alive.any(axis=0)
            if wanted.mean() < 0.8:
                cols, sums, alive = cols[wanted], sums[:, wanted], alive[:, wanted]
            if alive.mean() < SPARSE if alive.size else True:
                pairs = np.nonzero(alive)
                sums = sums[pairs]
        else:
            a, b = pairs
            at = cols[b]
            sums = sums + (q[:, a] * c[:, at].astype(exact)).sum(axis=0)
            reach = np.sqrt(left_q[a]) * np.sqrt(left_x[at])
            stay = _ceiling(sums, reach) >= best.needs[lo + a]
            pairs, sums = (a[stay], b[stay]), sums[stay]
    if pairs is None:
        pairs = np.nonzero(alive)
        sums = sums[pairs]
    best.add(lo + pairs[0], x.ids[cols[pairs[1]]], sums)


def _blocks(table: pa.Table) -> Iterator[tuple[Block, np.ndarray]]:
    floors = table.column("floor").to_pylist() if "floor" in table.column_names else [None] * table.num_rows
    for ids, code, parts, floor in zip(*(table.column(c).to_pylist() for c in ("ids", "code", "parts")), floors, strict=True):
        block = Block(ids, code, parts)
        yield block, np.frombuffer(floor, np.float64).copy() if floor else np.full(len(block.ids), -np.inf)


def search(rows: pa.Table, queries: pa.Table, k: int) -> Iterator[tuple[Block, Best]]:
    """Per block of queries the best of one cell of rows; no more than one cell of each is held."""
    held = [b for b, _ in _blocks(rows)]
    for block, floor in _blocks(queries):
        dims = sum(len(p) for p in block.parts)
        top = float(block.top) * max((float(b.top) for b in held), default=0.0) * dims
        exact = np.float64 if top < 2.0**53 else object  # whole numbers either way
        best = Best(len(block.ids), k, floor, np.int64 if exact is np.float64 else object)
        for x in held:
            for lo in range(0, len(block.ids), QUERY_ROWS):
                _scan(x, block, lo, min(lo + QUERY_ROWS, len(block.ids)), best, exact)
        yield block, best


def _floors(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        floors = [best.needs.astype(np.float64).tobytes() for _, best in search(rows, queries, k)]
        return queries.select(["ids", "code", "parts", "g"]).append_column("floor", pa.array(floors, pa.binary()))
    return run


def _found(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out = [(block.ids[best.query], best.id, np.clip(best.score, LOW, HIGH).astype(np.int64)) for block, best in search(rows, queries, k)]
        return pa.table([pa.array(np.concatenate([o[i] for o in out]) if out else [], pa.int64()) for i in range(3)],
                        names=["query_id", "vec_id", "score"])
    return run


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of all other rows for each id divisible by ``every``."""
    spark = vectors.sparkSession
    tables = Scratch(spark)
    all_rows = usable(vectors).where("vec_id is not null")
    asked = all_rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = tables.put("topk-rows", all_rows.mapInArrow(_cut(BLOCK_ROWS), BLOCK))
    queries = tables.put("topk-queries", asked.mapInArrow(_cut(BLOCK_ROWS), BLOCK))
    sizes = [t.agg(F.coalesce(F.sum(F.length("ids") / 8), F.lit(0)).cast("bigint"), F.count("*")).first() for t in (rows, queries)]
    (n_rows, row_blocks), (n_queries, _) = sizes
    cells = max(1, -(-n_rows // ROW_CELL), min(row_blocks, spark.sparkContext.defaultParallelism))
    groups = max(1, -(-n_queries // QUERY_CELL))
    rows = rows.withColumn("c", F.pmod(F.xxhash64("ids"), F.lit(cells)).cast("int"))
    queries = queries.withColumn("g", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    # each group of queries meets one cell first
    first = rows.where(F.col("c") < groups).withColumn("g", F.col("c")) if groups <= cells else rows.withColumn(
        "g", F.explode(F.sequence(F.col("c"), F.lit(groups - 1), F.lit(cells))))
    started = tables.put("topk-floors", first.groupBy("g").cogroup(queries.groupBy("g")).applyInArrow(_floors(k), f"{BLOCK}, g int, floor binary"))
    left = rows.select("*", _every(groups).alias("g")).groupBy("g", "c")
    right = started.select("*", _every(cells).alias("c")).groupBy("g", "c")
    found = tables.put("topk-found", left.cogroup(right).applyInArrow(_found(k), FOUND))
    tables.drop("topk-rows", "topk-queries", "topk-floors")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
