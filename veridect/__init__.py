"""Synthetic-media detection analytics as PySpark DataFrame operators."""
