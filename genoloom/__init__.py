"""Interval and variant analytics on PySpark."""
