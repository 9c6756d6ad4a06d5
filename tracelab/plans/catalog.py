"""All queries of the library's own operators: importing their modules registers them."""

from __future__ import annotations

from tracelab.plans import experiment_queries, result_queries, snapshot_queries, streaming_queries, switch_queries, tenant_queries, topology_queries, trace_queries, usage_queries, workload_queries  # noqa: F401
from tracelab.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
