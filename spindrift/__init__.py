"""Spark-first analytics for point events recorded next to dense sensor series."""
