"""All queries of the library but those of the subpackage llm."""

from . import aggregate_queries, classify_queries, join_queries, reading_queries, span_queries, store_queries, text_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "aggregate_queries", "classify_queries", "join_queries", "reading_queries", "span_queries", "store_queries", "text_queries"]
