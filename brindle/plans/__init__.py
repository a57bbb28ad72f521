"""All queries, by name."""

from brindle.plans import curation_queries, log_queries, operator_queries, retrieval_queries, source_queries, table_queries, text_queries  # noqa: F401
from brindle.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
