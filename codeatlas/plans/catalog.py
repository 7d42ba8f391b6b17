"""All registered queries."""

from . import (map_queries, review_queries, scalar_queries, scan_queries, source_queries, stream_queries,
               structure_queries)  # noqa: F401  (registering)
from .registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
