"""SQL twins of the registered queries, for checking results with DuckDB."""

from oracles.build import all_sql

__all__ = ["all_sql"]
