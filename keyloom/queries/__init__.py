"""The operator queries over the sample tables, each with an equal SQL query where one exists."""

from __future__ import annotations

from .registry import ORACLES, QUERIES
from . import (  # noqa: F401  (importing registers the queries)
    aggregates,
    approx,
    eventlogs,
    io,
    joins,
    jobs,
    layout,
    order_sets,
    persistence,
    projections,
    reuse,
    sampling,
    udfs,
    vectors,
)

__all__ = ["ORACLES", "QUERIES"]
