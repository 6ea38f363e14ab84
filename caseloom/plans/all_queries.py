"""All registered queries of the library."""

from . import audit_queries, healing_queries, more_queries, rule_queries, source_queries, stream_queries  # noqa: F401  register their queries
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
