"""All named queries and their SQL counterparts."""

from __future__ import annotations

from isotrend.plans import change_queries, ingest_queries, model_queries, reshape_queries, trend_queries, wide_queries

MODULES = (change_queries, trend_queries, model_queries, reshape_queries, ingest_queries, wide_queries)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
