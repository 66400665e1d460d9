"""Registered queries, grouped like the operator inventory."""

from panelspark.plans.registered import (  # noqa: F401
    aggregates,
    joins,
    mart_tables,
    quality,
    reshape,
    scans,
    statistics,
    windows,
)
from panelspark.plans.registered.spec import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
