"""Ordered logic that stays parallel when one key holds a large share of the rows.

A plain window sends a whole key to one task.  Here rows are cut into (key, chunk)
pieces by their order column; the window runs inside a piece, and only one summary row
per piece is ordered per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.session import materialise

CHUNK = 1 << 16


def _chunked(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(order) / F.lit(width)).cast("bigint"))


def rank_within(df: DataFrame, keys: list[str], order: str, out: str = "rn", width: int = CHUNK) -> DataFrame:
    """1-based position of each row in its key by a unique integral ``order`` column."""
    pieces = _chunked(df, order, width)
    part = [*keys, "_chunk"]
    inner = Window.partitionBy(*part).orderBy(order)
    outer = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        pieces.groupBy(*part).agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(outer), F.lit(0)))
        .drop("_n")
    )
    ranked = pieces.withColumn("_in", F.row_number().over(inner))
    return (
        _null_safe_join(ranked, before, part)
        .withColumn(out, F.col("_in") + F.col("_before"))
        .drop("_in", "_before", "_chunk")
    )


def running_total(df: DataFrame, keys: list[str], order: str, value: Column, out: str, width: int = CHUNK) -> DataFrame:
    """Sum of ``value`` over the rows of the key before this one, by a unique integral ``order`` column."""
    pieces = _chunked(df, order, width).withColumn("_v", value)
    part = [*keys, "_chunk"]
    prior = lambda cols, by: Window.partitionBy(*cols).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    before = pieces.groupBy(*part).agg(F.sum("_v").alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(prior(keys, "_chunk")), F.lit(0))).drop("_n")
    local = pieces.withColumn("_in", F.coalesce(F.sum("_v").over(prior(part, order)), F.lit(0)))
    return _null_safe_join(local, before, part).withColumn(out, F.col("_in") + F.col("_before")).drop("_in", "_before", "_v", "_chunk")


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def carry_forward(
    df: DataFrame, keys: list[str], order: str, cols: dict[str, Column], strict: bool = False, width: int = CHUNK
) -> DataFrame:
    """Latest non-null value of each expression at or (``strict``) before the current row."""
    named = {f"_v{i}": (out, expr) for i, (out, expr) in enumerate(cols.items())}
    pieces = _chunked(df, order, width).withColumns({v: expr for v, (_, expr) in named.items()})
    part = [*keys, "_chunk"]
    inner = Window.partitionBy(*part).orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1 if strict else 0)
    outer = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    summary = pieces.groupBy(*part).agg(*[
        F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.col(order))).alias(f"_last{v}") for v in named
    ])
    summary = summary.select(*part, *[
        F.last(f"_last{v}", ignorenulls=True).over(outer).alias(f"_prev{v}") for v in named
    ])
    local = pieces.withColumns({f"_here{v}": F.last(v, ignorenulls=True).over(inner) for v in named})
    joined = _null_safe_join(local, summary, part)
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[F.coalesce(f"_here{v}", f"_prev{v}").alias(out) for v, (out, _) in named.items()],
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], columns: list[str] | None = None) -> DataFrame:
    """Whole row with the smallest order tuple per key, by a mergeable aggregate."""
    columns = columns or [c for c in df.columns if c not in keys]
    pick = F.min_by(F.struct(*columns), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, "_row.*")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rn") -> DataFrame:
    """At most ``k`` rows per key.

    Spark prunes each map task to its own first ``k`` rows per key before the shuffle
    (window group limit), so a hot key costs k rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def place_all(df: DataFrame, order: list[Column], keys: list[str] | None = None, out: str = "place",
              ranges: int | None = None) -> DataFrame:
    """Add ``out``: the 1-based, gapless place of every row in ``order`` over the whole table.

    With ``keys`` places start anew in each key.  Rows are dealt into sampled ranges of the whole
    composite order (and of their arrival, so that equal rows do not pile up in one range) and
    numbered where they lie; only one count per (key, range) is ordered.  No window sees the rows,
    and neither a hot key nor the table as a whole reaches one task.  The ranges are written once,
    so counts and places come from the same deal; the caller reads it back in range order.

    Rows equal in ``order`` get neighbouring places in either order; an empty table stays empty.
    """
    keys = keys or []
    by = [*[F.col(k) for k in keys], *order, F.col("_tie")]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(ranges, *by) if ranges else dealt.repartitionByRange(*by)
    # the low 33 bits count the rows of a task in the order they pass
    numbered = dealt.sortWithinPartitions(*by).drop("_tie").withColumns({
        "_range": F.spark_partition_id(), "_in": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    rows = materialise(numbered, "places")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_n"), F.min("_in").alias("_first")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return _null_safe_join(rows, starts, [*keys, "_range"]).withColumn(
        out, F.col("_before") + F.col("_in") - F.col("_first") + 1).drop("_range", "_in", "_first", "_before")
