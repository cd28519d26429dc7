"""Ordered-timeline and interval analytics on PySpark."""
