"""Spark-first analytics over framed, timed, multi-stream data."""
