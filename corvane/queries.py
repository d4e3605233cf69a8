"""All registered queries and their SQL."""

from __future__ import annotations

from . import catalogue_graph, catalogue_search  # noqa: F401  they register theirs
from .catalogue import ORACLE_SQL, QUERIES, flagship

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]
