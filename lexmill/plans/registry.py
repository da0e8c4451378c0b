"""All registered queries and their SQL."""

from __future__ import annotations

from . import aggregate_queries, base, filter_queries, graph_queries, hybrid, import_queries, join_queries, more_queries, parsing_queries, quality_queries, relational, retrieval, review_queries, rule_queries, serving_queries, staged_queries, statute_queries, stream_queries, text_queries, time_graph, whole_rules  # noqa: F401


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
