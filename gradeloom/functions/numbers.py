"""Rounding rules and the three medians that must not be mixed up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_up_half(value: Column, digits: int) -> Column:
    """Half goes toward +infinity: -0.8125 -> -0.812 and 0.8125 -> 0.813 at three digits."""
    scale = float(10 ** digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def upper_median(value: str) -> Column:
    """Element at position n div 2 of the ascending order.

    Read from the other end this is the discrete median of the descending order, which
    Spark computes from mergeable value counts rather than from a collected list.
    """
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)")


def half_point_median(samples: Column) -> Column:
    """Median of one row's samples; an even count averages the middle two to a half point."""
    ordered = F.array_sort(samples)
    size = F.size(samples)
    mid = F.floor(size / 2).cast("int")
    middle_two = (F.get(ordered, mid - 1) + F.get(ordered, mid)) / 2.0
    return (
        F.when(size == 0, F.lit(None).cast("double"))
        .when(size % 2 == 1, F.get(ordered, mid))
        .otherwise(F.floor(middle_two * 2.0 + 0.5) / 2.0)
    )


def safe_ratio(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))
