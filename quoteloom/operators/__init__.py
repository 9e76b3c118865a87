"""Batch operators, one module per family."""
