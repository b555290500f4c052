"""All queries over the driver's tables by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from .plans import dialogue, documents, learning, observability, relational, retrieval, rules, streams, structure, turns  # noqa: F401
from .plans._registry import ORACLE_SQL, QUERIES

FLAGSHIP = "class_health_score"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
