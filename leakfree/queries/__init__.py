"""Registered queries, grouped by operator family."""

import importlib

MODULES = ("ctes", "adapters", "projections", "windows", "joins", "aggregates", "topset", "models", "sources")


def load():
    """Import every query module once and return the registry."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return importlib.import_module(f"{__name__}.base")
