"""Queries over the given tables, grouped as in the operator inventory."""

from gradeloom.catalog import (  # noqa: F401
    aggregates,
    checks,
    dedup,
    filters,
    joins,
    projections,
    scans,
    scoring,
    signals,
    streams,
    windows,
)
from gradeloom.catalog.base import ORACLES, QUERIES  # noqa: F401
