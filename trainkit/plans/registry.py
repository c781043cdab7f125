"""All queries over the given tables and their DuckDB twins, by name."""

from __future__ import annotations

from trainkit.plans import array_queries, frame_queries, quantize_queries, run_queries, scoring_queries, split_queries, stream_queries
from trainkit.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "array_queries", "frame_queries", "quantize_queries", "run_queries", "scoring_queries", "split_queries", "stream_queries"]
