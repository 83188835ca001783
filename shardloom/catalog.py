"""All queries of the table operators, and the SQL that gives the same rows."""

from __future__ import annotations

from .queries import ORACLE_SQL, QUERIES, comparing, layouts, logging, merging, routing, shaping, values  # noqa: F401

__all__ = ["ORACLE_SQL", "QUERIES"]
