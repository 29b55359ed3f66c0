"""Sequence matching, mosaic analytics and signal features as Spark DataFrame operations."""
