"""Joins in which a missing key value equals a missing key value."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.functions.nullsafe import col


def natural_join(
    left: DataFrame, right: DataFrame, how: str = "inner", on: list[str] | None = None,
    suffixes: tuple[str, str] = (".x", ".y"), expect: list[str] | None = None,
) -> DataFrame:
    """Join on all common columns (or on ``on``); each key column appears once.

    Columns outside the key that both sides have get the suffixes.  ``expect`` states the key
    the caller has in mind, so a drifted schema fails instead of joining on something else.
    """
    keys = on or [c for c in left.columns if c in right.columns]
    if not keys:
        raise ValueError("the two sides have no common column")
    if expect is not None and sorted(expect) != sorted(keys):
        raise ValueError(f"joining on {keys}, expected {expect}")
    r = right.select(*[F.col(f"`{c}`").alias(f"_r_{i}") for i, c in enumerate(right.columns)])
    at = {c: f"_r_{i}" for i, c in enumerate(right.columns)}
    cond = reduce(and_, [F.col(f"`{k}`").eqNullSafe(F.col(at[k])) for k in keys])
    joined = left.join(r, cond, how)
    if how in ("left_semi", "left_anti"):
        return joined
    shared = [c for c in left.columns if c in right.columns and c not in keys]

    def key(k: str) -> Column:
        if how == "right":
            return F.col(at[k])
        if how in ("full", "outer", "full_outer"):
            return F.coalesce(F.col(f"`{k}`"), F.col(at[k]))
        return F.col(f"`{k}`")

    out = [key(c).alias(c) if c in keys
           else F.col(f"`{c}`").alias(c + suffixes[0] if c in shared else c) for c in left.columns]
    out += [F.col(at[c]).alias(c + suffixes[1] if c in shared else c)
            for c in right.columns if c not in keys]
    return joined.select(*out)


def keep_members(df: DataFrame, column: str, of: DataFrame, values: str | None = None) -> DataFrame:
    """Rows whose value occurs in a column of another table."""
    known = of.select(F.col(values or column).alias(column)).distinct()
    return natural_join(df, known, "left_semi", on=[column])


def drop_members(df: DataFrame, column: str, of: DataFrame, values: str | None = None) -> DataFrame:
    """Rows whose value does not occur in a column of another table; a null value stays."""
    known = of.select(F.col(values or column).alias(column)).distinct()
    return natural_join(df, known, "left_anti", on=[column])


def union_all(*tables: DataFrame) -> DataFrame:
    """Stack tables by column name; a column that a table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def ceiling_level(value, levels: list) -> tuple[Column, Column]:
    """Smallest level that is at least the value, and its 1-based place; null above the last."""
    lv = F.array(*[F.lit(x) for x in levels])
    v = col(value)
    level = F.get(F.filter(lv, lambda x: x >= v), F.lit(0))
    return level, F.when(level.isNotNull(), F.array_position(lv, level))


def range_lookup(rows: DataFrame, value: str, ranges: DataFrame, low: str, high: str) -> DataFrame:
    """Rows with the ranges that hold their value, both ends included, for a small fixed number of ranges.

    The ranges travel as one array, so the rows are neither shuffled nor joined.
    """
    held = ranges.agg(F.collect_list(F.struct(*ranges.columns)).alias("_held"))
    mine = F.filter("_held", lambda r: F.col(value).between(r[low], r[high]))
    return rows.join(F.broadcast(held)).withColumn("_r", F.explode(mine)).select(  # one row
        *rows.columns, *[F.col(f"_r.{c}").alias(c) for c in ranges.columns])


def range_join(
    rows: DataFrame, value: str, ranges: DataFrame, low: str, high: str, group: list[str] | None = None, cells: int = 1024,
) -> DataFrame:
    """Rows with the ranges that hold their value, both ends included, for any number of ranges.

    Cells are cut at about equal counts of the rows' own values, so they fit columns with long tails; a value that
    stands in very many rows has a cell to itself, which a join splits.  A range is repeated in every cell that it
    touches and a row has one cell, so the join is an equality on the cell (and on ``group``) before the ends are
    compared, and gives each match once.
    """
    group = group or []
    at = [i / cells for i in range(1, cells)]
    # one row with an array of ``cells`` numbers at most
    edges = rows.agg(F.coalesce(F.array_sort(F.array_distinct(F.percentile_approx(F.col(value).cast("double"), at, 10 * cells))),
                                F.array().cast("array<double>")).alias("_edges"))

    def cell_of(v: Column) -> Column:
        """Number of edges at or below the value, by halving."""
        steps = F.sequence(F.lit(0), F.lit(cells.bit_length()))
        start = F.struct(F.lit(0).alias("lo"), F.size("_edges").alias("hi"))

        def halve(s, _):
            mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            open_, below = s["lo"] < s["hi"], F.coalesce(F.get("_edges", mid) <= v, F.lit(False))
            return F.struct(F.when(open_ & below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(open_ & ~below, mid).otherwise(s["hi"]).alias("hi"))

        return F.aggregate(steps, start, halve)["lo"]

    spread = ranges.where(F.col(low) <= F.col(high)).join(F.broadcast(edges)).withColumn(
        "_cell", F.explode(F.sequence(cell_of(F.col(low)), cell_of(F.col(high))))).drop("_edges")
    r = spread.select(*[F.col(c).alias(f"_g_{c}") for c in group], *[c for c in spread.columns if c not in group])
    celled = rows.where(F.col(value).isNotNull()).join(F.broadcast(edges)).withColumn("_row_cell", cell_of(F.col(value))).drop("_edges")
    cond = (F.col("_row_cell") == F.col("_cell")) & F.col(value).between(F.col(low), F.col(high))
    for g in group:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return celled.join(r, cond).drop("_cell", "_row_cell", *[f"_g_{g}" for g in group])
