"""All queries over virtual repositories, with their SQL."""

from palimpsest.plans import snapshot_queries, store_queries
from palimpsest.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "snapshot_queries", "store_queries"]
