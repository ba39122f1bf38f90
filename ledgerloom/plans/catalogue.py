"""All registered queries of the accounts-payable engine."""

from ledgerloom.plans import analytics_queries, case_queries, document_queries, extraction_queries, history_queries, matching_queries, store_queries, stream_queries  # noqa: F401  registers them
from ledgerloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
