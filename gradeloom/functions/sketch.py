"""MinHash signatures, band keys and similarity estimates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

NUM_HASHES, BANDS, ROWS_PER_BAND = 96, 24, 4
_SLICE = 1_000_000
_SEED = 24_301


def _multipliers(num: int) -> tuple[np.ndarray, np.ndarray]:
    """The same odd multipliers and offsets in every Python worker."""
    rng = np.random.default_rng(_SEED)
    odd = rng.integers(1, 2**63, num, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rng.integers(0, 2**63, num, dtype=np.uint64)


def _signatures(flat: np.ndarray, starts: np.ndarray, num: int) -> np.ndarray:
    mult, offset = _multipliers(num)
    out = np.empty((len(starts), num), dtype=np.uint32)
    for i in range(num):
        mixed = (flat * mult[i] + offset[i]) >> np.uint64(32)
        out[:, i] = np.minimum.reduceat(mixed, starts)
    return out


@F.arrow_udf(ArrayType(IntegerType()))
def minhash(hashes: pa.Array) -> pa.Array:
    """96 minima per row over hashed shingles; a row without shingles gets zeros.

    The shingles of a batch are one flat array; about ``_SLICE`` of them are worked on at a time.
    """
    flat = hashes.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)
    lengths = hashes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    filled = np.flatnonzero(lengths)
    out = np.zeros((len(lengths), NUM_HASHES), dtype=np.int32)
    at = 0
    while at < len(filled):
        first = ends[filled[at]] - lengths[filled[at]]
        to = max(at + 1, int(np.searchsorted(ends[filled], first + _SLICE, side="right")))
        rows = filled[at:to]
        starts = ends[rows] - lengths[rows]
        out[rows] = _signatures(flat[first:ends[rows[-1]]], starts - first, NUM_HASHES).view(np.int32)
        at = to
    offsets = np.arange(len(lengths) + 1, dtype=np.int32) * NUM_HASHES
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))


def band_keys(signature: Column, bands: int = BANDS, rows: int = ROWS_PER_BAND) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda b: F.xxhash64(b, F.slice(signature, b * rows + 1, rows)),
    )


def jaccard_estimate(a: Column, b: Column) -> Column:
    """Share of equal signature slots; no signature means no similarity."""
    same = F.aggregate(
        F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda acc, v: acc + v
    )
    return F.when((F.size(a) > 0) & (F.size(b) > 0), same / F.size(a)).otherwise(F.lit(0.0))


def jaccard_exact(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))
