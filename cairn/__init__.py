"""Spark-first analytics: summarised clustering and association-network analysis."""
