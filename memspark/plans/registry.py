"""The table of registered queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from ..views import CTE

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

_NEEDS = {"v_access_log": ["v_events"]}


def sql(body: str, *views: str, ctes: str = "") -> str:
    """``body`` with the named view CTEs (and further ``ctes``) in front."""
    names: list[str] = []
    for v in views:
        for n in [*_NEEDS.get(v, []), v]:
            if n not in names:
                names.append(n)
    parts = [CTE[n] for n in names] + ([ctes.strip()] if ctes.strip() else [])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body.strip()


def query(name: str, oracle: str | None = None):
    """Register a ``(spark, sf_dir) -> DataFrame`` under ``name``."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return keep
