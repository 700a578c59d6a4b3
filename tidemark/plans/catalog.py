"""Every registered query, gathered by importing the modules that register them."""

from tidemark.plans import (  # noqa: F401
    board_queries,
    change_queries,
    erasure_queries,
    graph_queries,
    mart_queries,
    record_queries,
    stream_queries,
)
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
