"""Registered queries over the test tables, each with its SQL twin where one exists."""

from importlib import import_module

FAMILIES = ("ingest", "bars", "features", "micro", "labels", "signals", "ledger", "market", "evidence", "models", "streaming")


def load() -> None:
    for family in FAMILIES:
        import_module(f"quoteloom.catalog.{family}")
