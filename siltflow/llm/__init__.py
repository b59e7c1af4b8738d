"""Operators for training-data pipelines. Nothing else in siltflow imports this package."""
