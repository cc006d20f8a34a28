"""All queries of the engine and their DuckDB SQL."""

from __future__ import annotations

from . import align_queries, domain_queries, evidence_queries, flow_queries, graph_queries, log_queries, review_queries, trace_queries  # noqa: F401
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
