"""Registered queries and their DuckDB counterparts, one for each operator id."""

from siftwell.queries import analytics, rows, sources  # noqa: F401
from siftwell.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
