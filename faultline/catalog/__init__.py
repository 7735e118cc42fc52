"""Registered queries, their test views and the SQL they are checked against."""

from faultline.catalog import dictionary_queries, phase_queries, row_queries, run_queries, taxonomy_queries  # noqa: F401
from faultline.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
