"""Vectors as integers and blocks of them: what the operators over ``embeddings`` share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 64.0
LARGEST = float(1 << 62)


def whole(embedding: Column) -> Column:
    """True where a vector is there and every entry is a finite number."""
    return F.coalesce(F.forall(embedding, lambda e: e.isNotNull() & (F.abs(e) < F.lit(float("inf")))), F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows whose vector is whole; other columns are not read."""
    v = F.col("embedding").cast("array<double>")
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where(whole(F.col("v")))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """floor(64 * c) of list rows as int64; shorter rows are filled up with zeros."""
    lens = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(SCALE * flat), -LARGEST, LARGEST).astype(np.int64)
    out = np.zeros((len(lens), int(lens.max(initial=0)) if width is None else width), np.int64)
    out[np.arange(out.shape[1]) < lens[:, None]] = flat
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    top = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    return x.astype(next(t for t, most in ((np.int8, 127), (np.int16, 32767), (np.int32, 2**31 - 1), (np.int64, 2**63 - 1)) if top <= most))


def chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a partition dealt anew into batches of ``rows``; only the last may be shorter."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            batch = batch.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
