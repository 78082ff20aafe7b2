"""Column choice by name, position and pattern."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_position(df: DataFrame, *spans: tuple[int, int]) -> DataFrame:
    """Columns by 1-based inclusive position spans."""
    return df.select(*[c for a, b in spans for c in df.columns[a - 1:b]])


def named_like(df: DataFrame, prefixes: Iterable[str] = (), parts: Iterable[str] = ()) -> list[str]:
    """Names that start with a prefix or contain a part, whatever the case."""
    prefixes = tuple(p.lower() for p in prefixes)
    parts = [p.lower() for p in parts]
    return [c for c in df.columns
            if (prefixes and c.lower().startswith(prefixes)) or any(p in c.lower() for p in parts)]


def swapped(df: DataFrame, a: str, b: str) -> DataFrame:
    """Exchange the values of two columns in one projection."""
    names = {a: b, b: a}
    return df.select(*[F.col(names.get(c, c)).alias(c) for c in df.columns])


def across(df: DataFrame, columns: Iterable[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Apply one expression to several columns."""
    return df.withColumns({c: fn(F.col(c)) for c in columns})


def each(tables: Mapping[str, DataFrame], fn: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """Apply one flow to every table of a mapping."""
    return {name: fn(df) for name, df in tables.items()}
