"""Every registered query of the core library, and its SQL."""

from __future__ import annotations

from quarry.plans import call_queries, code_queries, dependency_queries, deployment_queries, finding_queries, graph_stream_queries, json_queries, lead_queries, receipt_queries, relational_queries, report_queries, rule_queries, service_queries, small_queries, text_queries, tool_queries  # noqa: F401  (they register)
from quarry.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]

FLAGSHIP = relational_queries.dashboard_status_counts
