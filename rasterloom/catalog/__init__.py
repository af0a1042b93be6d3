"""Registered queries, each with the SQL that must give the same rows."""

from importlib import import_module

MODULES = ["scenes", "statistics", "change", "sampling", "grids", "lines", "models", "reports"]


def load():
    from rasterloom.catalog import base

    for name in MODULES:
        import_module(f"rasterloom.catalog.{name}")
    return dict(base.QUERIES), dict(base.ORACLES)
