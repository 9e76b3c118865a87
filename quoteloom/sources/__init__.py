"""Readers, sinks and ingest steps."""
