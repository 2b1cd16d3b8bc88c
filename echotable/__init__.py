"""Spark-first analytics over archives of timed transcripts."""
