"""One registered query per operator over the given tables, with its SQL check."""

from glyphlake.catalog.registry import load_all, oracle_sql, queries

__all__ = ["load_all", "oracle_sql", "queries"]
