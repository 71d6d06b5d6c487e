"""Spatial-candidate analytics on PySpark.

Operators are functions from DataFrame to DataFrame, to be used with ``df.transform``.
"""
