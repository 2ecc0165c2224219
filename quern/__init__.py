"""Spark-first namespace-consistency analytics."""
