"""Readers and writers: parquet tables, CSV/JSON files, JDBC, stages and models."""
