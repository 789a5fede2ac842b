"""Registry of the engine's own queries and their SQL oracles."""

from __future__ import annotations

from . import authority_queries, context_queries, decision_queries, flow_queries, lookup_queries, ranking_queries, record_queries, resolution_queries, retrieval_queries, state_queries, text_queries
from .registry import ORACLE_SQL, QUERIES

FLAGSHIP = "retrieval_pipeline"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES", "authority_queries", "context_queries", "decision_queries", "flow_queries", "lookup_queries", "ranking_queries", "record_queries", "resolution_queries", "retrieval_queries", "state_queries", "text_queries"]
