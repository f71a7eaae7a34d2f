"""Operators for large-scale training-data pipelines. Nothing else in tessera imports this package."""
