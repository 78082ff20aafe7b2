"""Per-key operators that stay balanced when one key holds a large share of the rows.

Windows partitioned by an individual would put all of its rows into one task.  Here the value
of a key is computed by an aggregate, which combines on the map side, and brought back to the
rows by a join with one row per key: a large partition is then large on one side only, and
adaptive execution splits it.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.functions.nullsafe import order_struct

ROWS = "_rows"


def null_safe_equal(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(and_, [left[k].eqNullSafe(right[k]) for k in keys])


def first_per_key(
    df: DataFrame, keys: list[str], order: list, columns: list[str] | None = None
) -> DataFrame:
    """Row of each key that comes first in ``order`` (ascending, nulls last).

    ``order`` must end in a unique column.  Rows are reduced on the map side, so the shuffle
    carries one row per key and map task.
    """
    columns = [c for c in (columns or df.columns) if c not in keys]
    first = F.min_by(F.struct(*columns), order_struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*")


def attach_per_key(df: DataFrame, per_key: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Bring one row per key back to the rows of ``df``; null keys match null keys.

    ``per_key`` holds each key at most once; without keys it is one row that all rows get.
    """
    values = [c for c in per_key.columns if c not in keys and c != ROWS]
    right = per_key.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *values)
    if not keys:
        return df.join(F.broadcast(right), how=how).select(*df.columns, *values)  # one row
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return df.join(right, on, how).select(*df.columns, *values)


def with_group_values(df: DataFrame, keys: list[str], **values: Column) -> DataFrame:
    """Add aggregates of each key to its rows."""
    per_key = df.groupBy(*keys).agg(*[v.alias(name) for name, v in values.items()])
    return attach_per_key(df, per_key, keys)


def add_count(df: DataFrame, keys: list[str], out: str = "n") -> DataFrame:
    """Number of rows of each key, kept on the rows."""
    return with_group_values(df, keys, **{out: F.count(F.lit(1))})


def nested(df: DataFrame, keys: list[str], order: list, rows_per_part: int = 10_000) -> DataFrame:
    """Rows of a key along ``order``, which must be total, as arrays of structs of ``rows_per_part`` rows.

    Parts are numbered from 0 and follow each other in the order; each but the last of a key is full, and
    ``part_rows`` is the size of a part.
    """
    from fieldtrace.operators.ranks import row_numbers

    rest = [c for c in df.columns if c not in keys]
    numbered = row_numbers(df, keys, order, "_n").withColumn("part", F.floor((F.col("_n") - 1) / rows_per_part).cast("bigint"))
    packed = numbered.groupBy(*keys, "part").agg(
        F.array_sort(F.collect_list(F.struct("_n", F.struct(*rest).alias("row")))).alias("_data"))
    return packed.select(
        *keys, "part", F.size("_data").alias("part_rows"),
        F.transform("_data", lambda x: x["row"]).alias("data"))


def unnested(df: DataFrame, data: str = "data") -> DataFrame:
    """Inverse of ``nested``."""
    keys = [c for c in df.columns if c not in (data, "part", "part_rows")]
    return df.select(*keys, F.inline(data))
