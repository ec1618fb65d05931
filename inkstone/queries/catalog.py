"""All queries of the reference's operators."""

from inkstone.queries import kb, lifecycle, metrics, relational, streams, text
from inkstone.queries.registry import ORACLE, QUERIES

MODULES = [kb, lifecycle, metrics, relational, streams, text]
__all__ = ["ORACLE", "QUERIES"]
