"""Named queries over the test tables."""

from . import graph_queries, table_queries, text_queries  # noqa: F401
from .catalog import ORACLE, QUERIES, query

__all__ = ["ORACLE", "QUERIES", "query"]
