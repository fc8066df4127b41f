"""Queries over the driver's tables."""

from . import answer_queries, flow_queries, match_queries, parse_queries, reader_queries, scalar_queries, stream_queries, time_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
