"""Queries over the given tables, with their DuckDB forms."""

from .base import ORACLE, QUERIES, ROWS
from . import library, rows, scalars, scores, stored  # noqa: F401

__all__ = ["ORACLE", "QUERIES", "ROWS"]
