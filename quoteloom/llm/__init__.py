"""Operators and queries of training-data pipelines."""
