"""Parallel-text and journal analytics on PySpark."""
