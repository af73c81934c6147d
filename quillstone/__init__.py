"""Spark-first analytics over block-structured, append-mostly event data."""
