"""Importing the modules fills the registry."""

from vinegrid.queries import exports, pixels, space, tables  # noqa: F401
from vinegrid.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
