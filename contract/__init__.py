"""Contract queries over the given tables, with their SQL counterparts."""

from contract import cohort_queries, events_queries, results_queries, strata_queries  # noqa: F401
from contract.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
