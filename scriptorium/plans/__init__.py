"""Registered queries over the given tables."""

from scriptorium.plans import audit, boq, lifecycle, search, streams  # noqa: F401
from scriptorium.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
