"""Registered queries, one module per part of the operator inventory."""

import importlib

from . import registry

MODULES = ["enrich", "ingest", "joins", "analytics", "ordering", "retrieval", "lifecycle", "graph", "rollups", "streams",
           "evaluation"]


def _load():
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")


def all_queries():
    _load()
    return registry.QUERIES


def all_oracles():
    _load()
    return registry.ORACLES
