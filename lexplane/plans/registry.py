"""Names of all queries of the reference's operators, with the SQL that must agree."""

from __future__ import annotations

from . import document_queries, rule_queries  # noqa: F401, their queries register themselves
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
