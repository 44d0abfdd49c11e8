"""Registered queries: each key of SURVEY §2 as a Spark plan plus its DuckDB oracle SQL."""
