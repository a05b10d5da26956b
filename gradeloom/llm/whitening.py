"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers x = floor(64 * c) + 1000000.  The fit list is each distinct vector
once; it is written as blocks of integers, and A is its rows minus their mean.  Each step is two
products over the blocks, A v and then A' u, whose sums come back as a few numbers a dimension:

    A v[j] = beta[j-1] u[j-1] + alpha[j] u[j]        A' u[j] = alpha[j] v[j] + beta[j] v[j+1]

A left vector has one entry per row, so it is never gathered: u = A p, and only p (one number a
dimension) is kept.  A product with A computes the entries of all earlier u of its rows again
and returns their inner products, so each u is orthogonalised against all earlier ones; a pass
is repeated while too much was cancelled.  Each v is orthogonalised against all earlier v twice.
A direction in which nothing is left ends a run; the next one starts from a fresh vector, so
equal variances and dependent dimensions are found too.  All ``d`` steps give the complete
decomposition; ``steps`` stops sooner for very wide vectors.  The SVD of the small bidiagonal
gives components and deviations.

Sums S are whole numbers, and rows are centred as (n * x - S) / n before any product.

Defined cases: null vectors and those with null or non-finite entries are dropped; shorter ones
count as filled up with c = 0; entries beyond 2**40 count as that; repeated rows stay in the result and count once in the fit;
components without variance (fewer distinct vectors than dimensions, constant dimensions) are
not returned, so one distinct vector gives no rows; an empty table gives none; a deviation
beyond a long is null; a null vec_id stays null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.common import Scratch
from gradeloom.llm.vectors import chunks, matrix, narrow, usable

LARGEST = 1 << 40
BLOCK_ROWS = 1 << 13
COMPONENTS = 16
NOTHING = 1e-11  # share of the norm of A below which a direction holds nothing
AGAIN = 0.1  # a pass is repeated when less than this share of a vector's square is left
SEED = 20

BLOCK = "code string, rows int, x binary"
OUT = ("vec_id bigint, component array<int>, deviation bigint, whitened array<double>")


def integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(64 * c); the offset of 1000000 is left out, as it cancels in all that follows."""
    return np.clip(matrix(column, width), -LARGEST, LARGEST)


def _blocks(width: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(it, BLOCK_ROWS):
            x = narrow(integers(batch.column(0), width))
            yield pa.RecordBatch.from_arrays([pa.array([x.dtype.str]), pa.array([len(x)], pa.int32()), pa.array([x.tobytes()])], ["code", "rows", "x"])
    return batches


class Fit:
    """The fit list as written blocks, and sums of functions of its rows."""

    def __init__(self, spark: SparkSession, blocks: DataFrame, width: int):
        self.spark, self.blocks, self.width = spark, blocks, width
        self.n, self.total = 0, np.zeros(width, np.int64)

    def summed(self, of: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
        """``of(x)`` of each block (integers without the offset), added up."""
        width, dtype = self.width, np.int64 if kind == "bigint" else np.float64

        def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = None
            for batch in it:
                for code, rows, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    part = of(np.frombuffer(raw, np.dtype(code)).reshape(rows, width).astype(np.int64))
                    mine = part if mine is None else mine + part
            if mine is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(mine))), pa.array(mine.astype(dtype))], ["at", "value"])
        rows = self.blocks.mapInArrow(partial, f"at bigint, value {kind}").groupBy("at").agg(F.sum("value").alias("value")).collect()
        out = np.zeros(len(rows), dtype)
        for r in rows:
            out[r["at"]] = r["value"]
        return out

    def count(self) -> Fit:
        sums = self.summed(lambda x: np.concatenate([[len(x)], x.sum(axis=0)]), "bigint")
        if len(sums):
            self.n, self.total = int(sums[0]), sums[1:]
        return self

    def over(self, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """As ``summed``, over centred rows as doubles."""
        n, total = self.n, self.total
        return self.summed(lambda x: of(_centred(x, n, total)), "double")


def _centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    if n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) < 1 << 62:
        return (n * x - total) / n
    return x - total / n


def bidiagonalise(fit: Fit, steps: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(right vectors as columns, bidiagonal B with A V = U B, squared norm of A)."""
    d = fit.width
    steps = d if steps is None else min(steps, d)
    norm = float(fit.over(lambda a: np.array([(a * a).sum()]))[0])
    nothing = (NOTHING ** 2) * norm
    rng = np.random.default_rng(SEED)
    right, left = np.zeros((d, 0)), np.zeros((d, 0))
    alpha, beta = np.zeros(steps), np.zeros(steps)

    def fresh() -> np.ndarray:
        v = rng.standard_normal(d)
        for _ in range(3):
            v -= right @ (right.T @ v)
            v /= np.linalg.norm(v)
        return v

    v = fresh()
    for j in range(steps):
        right = np.column_stack([right, v])
        p = v
        while True:  # u = A p, orthogonal to all earlier u
            sums = fit.over(lambda a, p=p, left=left: _products(a, p, left))
            square, shared = sums[0], sums[1:]
            p = p - left @ shared
            rest = square - shared @ shared
            if rest <= nothing or rest > AGAIN * square:
                break
        if rest > nothing:
            sums = fit.over(lambda a, p=p: _back(a, p))
            alpha[j] = np.sqrt(sums[0])
        if alpha[j] ** 2 <= nothing:
            alpha[j] = 0.0
            left = np.column_stack([left, np.zeros(d)])
            w = np.zeros(d)
        else:
            left = np.column_stack([left, p / alpha[j]])
            w = sums[1:] / alpha[j]
            for _ in range(2):
                w = w - right @ (right.T @ w)
        if j + 1 == steps:
            break
        beta[j] = np.linalg.norm(w)
        if beta[j] ** 2 <= nothing:
            beta[j] = 0.0
            v = fresh()
        else:
            v = w / beta[j]
    return right, np.diag(alpha) + np.diag(beta[:-1], 1), norm


def _products(a: np.ndarray, p: np.ndarray, left: np.ndarray) -> np.ndarray:
    y = a @ p
    return np.concatenate([[y @ y], (a @ left).T @ y])


def _back(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    u = a @ p
    return np.concatenate([[u @ u], u @ a])


class Whitening:
    """Components, deviations and shares of the variance of one fit list."""

    def __init__(self, fit: Fit, most: int = COMPONENTS, steps: int | None = None):
        self.n, self.total, self.width = fit.n, fit.total, fit.width
        self.components, self.deviations, self.explained = np.zeros((fit.width, 0)), np.zeros(0), np.zeros(0)
        self.error = 0.0
        if fit.n < 2 or not fit.width:
            return
        right, small, norm = bidiagonalise(fit, steps)
        if not norm:
            return
        _, sigma, turned = np.linalg.svd(small)
        keep = sigma[:most] > 10 * NOTHING * np.sqrt(norm)
        c = right @ turned[:most].T[:, keep]
        # either sign is right; the largest entry is made positive
        c *= np.sign(c[np.abs(c).argmax(axis=0), np.arange(c.shape[1])])
        self.components = c
        self.deviations = sigma[:most][keep] / np.sqrt(fit.n)
        self.explained = sigma[:most][keep] ** 2 / norm
        self.error = self._identity_error(fit)

    def _identity_error(self, fit: Fit) -> float:
        k, scaled = len(self.deviations), self.components / self.deviations
        sums = fit.over(lambda a: _moments(a @ scaled))
        mean = sums[:k] / fit.n
        return float(np.abs(sums[k:].reshape(k, k) / fit.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))

    def applied(self, rows: DataFrame) -> DataFrame:
        """One row per vector of ``rows`` (vec_id, v) and component."""
        n, total, width, scale = self.n, self.total, self.width, self.components / self.deviations

        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                x = integers(batch.column(1), width)
                w = _centred(x, n, total) @ scale
                numbers = np.tile(np.arange(1, scale.shape[1] + 1, dtype=np.int32), (len(x), 1))
                ends = pa.array(np.arange(len(x) + 1) * scale.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.ListArray.from_arrays(ends, pa.array(numbers.ravel())), _deviations(x, n, total),
                    pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], ["vec_id", "component", "deviation", "whitened"])
        out = rows.mapInArrow(batches, OUT).select(
            "vec_id", "deviation", F.explode(F.arrays_zip("component", "whitened")).alias("c"))
        shares = F.array(*[F.lit(float(e)) for e in self.explained]) if len(self.explained) else F.array().cast("array<double>")
        return out.select(
            "vec_id", F.col("c.component").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation",
            F.col("c.whitened").alias("whitened"), F.element_at(shares, F.col("c.component")).alias("explained"),
            F.lit(self.error).alias("identity_error"))


def _moments(w: np.ndarray) -> np.ndarray:
    return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])


def _deviations(x: np.ndarray, n: int, total: np.ndarray) -> pa.Array:
    """Sum over dimensions of (n * x - S) ** 2, exactly; null beyond a long."""
    most = max((abs(n * int(x.min(initial=0)) - int(s)) + abs(n * int(x.max(initial=0)) - int(s)) for s in total), default=0)
    if most ** 2 * max(1, x.shape[1]) < 1 << 63:
        return pa.array(((n * x - total) ** 2).sum(axis=1), pa.int64())
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total, strict=True)) for row in x]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def whitened(vectors: DataFrame, most: int = COMPONENTS, steps: int | None = None) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row."""
    spark = vectors.sparkSession
    tables = Scratch(spark)
    rows = usable(vectors)
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    # -0.0 and 0.0 are one whole number; equal numbers are one vector, however long it was written
    edge = F.lit(float(LARGEST))
    cut = F.transform(F.col("v"), lambda c: F.floor(F.greatest(-edge, F.least(edge, 64 * c))))
    filled = F.concat(cut, F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size("v")))
    distinct = rows.select(filled.alias("x")).distinct()
    blocks = tables.put("whitening-fit", distinct.select(F.transform("x", lambda c: c.cast("double") / 64).alias("v")).mapInArrow(_blocks(width), BLOCK))
    model = Whitening(Fit(spark, blocks, width).count(), most, steps)
    tables.drop("whitening-fit")
    return model.applied(rows)
