"""Tagwell: a Spark-first engine for retail price publications."""
