"""Every operator as a query over the shared tables, with its SQL twin where SQL can say it."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "flagship", "sources", "tables", "signal", "selection", "metrics", "routing", "models", "flows",
)


def _catalogs():
    return [import_module(f"clipscore.catalog.{name}").catalog for name in MODULES]


def all_queries() -> dict:
    return {k: q for c in _catalogs() for k, q in c.queries.items()}


def all_oracles() -> dict[str, str]:
    return {k: q for c in _catalogs() for k, q in c.oracles.items()}


def flagship(spark, sf):
    return all_queries()["flagship_blend_min_dcf"](spark, sf)
