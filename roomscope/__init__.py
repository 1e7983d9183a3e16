"""Spark-first spatial scene analytics."""
