"""Operators for large training-data corpora: one module each, queries and SQL in ``entry``."""
