"""Registered queries: each with the inventory rows it covers and, where possible, equal SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame

from fieldtrace.sources.fixtures import Tables, as_plain_sql

MODULES = (
    "tables", "cleaning", "joins", "grouping", "seasons", "places", "spatial", "models", "densities", "flows")


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: Callable[[Tables], DataFrame]
    sql: str | None


_QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):
    """Register the function under its own name."""

    def register(fn: Callable[[Tables], DataFrame]):
        if fn.__name__ in _QUERIES:
            raise ValueError(f"query {fn.__name__} is registered twice")
        _QUERIES[fn.__name__] = Query(
            fn.__name__, tuple(covers.split()), fn, as_plain_sql(sql) if sql else None)
        return fn

    return register


def all_queries() -> dict[str, Query]:
    for module in MODULES:
        import_module(f"fieldtrace.catalog.{module}")
    return dict(_QUERIES)
