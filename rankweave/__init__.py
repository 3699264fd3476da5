"""Spark-first analytics for click logs: ingest, split, retrieve, rank, evaluate."""
