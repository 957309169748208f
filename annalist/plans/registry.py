"""All queries of the library."""

from __future__ import annotations

from annalist.plans import acts, aggregates, documents, domain, governance, notices, reads, regional, sources, stateful
from annalist.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "acts", "aggregates", "documents", "domain", "governance", "notices", "reads", "regional", "sources", "stateful"]
