"""Spark-first analytics over single-room floor layouts."""
