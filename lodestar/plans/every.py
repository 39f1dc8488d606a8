"""All registered queries of the engine and their SQL."""

from . import catalog, context_queries, control_queries, knowledge_queries, store_queries  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
