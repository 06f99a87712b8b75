"""The queries this repository answers over the provided tables."""

from workload.registry import ORACLES, QUERIES
from workload import q_files, q_graph, q_checks, q_plans, q_calls, q_changes, q_reports, q_tables  # noqa: F401

__all__ = ["QUERIES", "ORACLES"]
