"""Gapless ranks inside keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE_ROWS = 1 << 14


def rank_in_key(df: DataFrame, keys: list[str], spread: Column, order: list[str], largest: int, out: str = "rank") -> DataFrame:
    """Add ``out``, 0-based and gapless in each key, without gathering a key in one task.

    Rows are cut into pieces by a hash of ``spread``; a window ranks inside a piece and one
    row per piece is summed up per key.  ``largest`` (rows of the largest key) sets the number
    of pieces, so a piece has about ``PIECE_ROWS`` rows however large a key is.
    """
    n = max(1, -(-largest // PIECE_ROWS))
    part = [*keys, "_piece"]
    cut = df.withColumn("_piece", F.pmod(F.xxhash64(spread), F.lit(n)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*part).agg(F.count("*").alias("_n")).select(
        *part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1
    return cut.withColumn("_in", inner).join(offsets, part).withColumn(out, F.col("_in") + F.col("_before")).drop("_in", "_before", "_piece")
