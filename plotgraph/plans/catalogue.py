"""Query catalogue over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from . import access_queries, cell_queries, graph_queries, pipeline_queries, registry_queries
from .graph_queries import trace_forward

_PARTS = (graph_queries, cell_queries, registry_queries, pipeline_queries, access_queries)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL = {name: text for part in _PARTS for name, text in part.ORACLE_SQL.items()}

__all__ = ["ORACLE_SQL", "QUERIES", "trace_forward"]
