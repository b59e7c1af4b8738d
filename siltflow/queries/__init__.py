"""Queries over the test tables, each with its SQL for DuckDB."""
