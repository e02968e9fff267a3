"""Registered queries: retail frames over the given tables, and one query per operator."""

from catalog.registry import ORACLES, QUERIES
from catalog import modeling, relational, scalar, workflows  # noqa: F401,E402

__all__ = ["ORACLES", "QUERIES"]
