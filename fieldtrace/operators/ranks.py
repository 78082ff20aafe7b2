"""Numbering, running totals and exact quantiles without a single-task window.

For numbers and totals the rows are range-partitioned along the order, written once, and the
totals of the blocks are added up in a small table.  No task holds more than one block, whatever
the group sizes are.  Quantiles need no order of the rows: values are counted by size, then only
the counts around the wanted ranks are looked into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtrace.functions.nullsafe import sort_keys
from fieldtrace.sources.store import staged

_BLOCK_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def _as_sort_keys(order: list) -> list[Column]:
    out = []
    for c in order:
        out.append(c if isinstance(c, Column) else sort_keys(c)[0])
    return out


def _blocks(df: DataFrame, group: list[str], order: list) -> DataFrame:
    """``df`` range-partitioned along group and order, with block and place in the block."""
    keys = sort_keys(*group) + _as_sort_keys(order)
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    mid = F.monotonically_increasing_id()
    placed = placed.withColumn("_mid", mid)
    return staged(
        placed.withColumn("_block", F.shiftright("_mid", _BLOCK_BITS))
    )


def _block_offsets(block_totals: DataFrame, group: list[str]) -> DataFrame:
    """Total of the earlier blocks; a group has at most as many rows here as there are blocks."""
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    return block_totals.withColumn("_before", F.sum("_total").over(before))


def _join_offsets(rows: DataFrame, offsets: DataFrame, group: list[str]) -> DataFrame:
    o = offsets.select(*[F.col(g).alias(f"_o_{g}") for g in group],
                       F.col("_block").alias("_o_block"), *[c for c in offsets.columns if c in ("_before", "_block_start")])
    on = F.col("_block") == F.col("_o_block")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    return rows.join(o, on).drop("_o_block", *[f"_o_{g}" for g in group])


def row_numbers(df: DataFrame, group: list[str], order: list, out: str = "row_number") -> DataFrame:
    """Number the rows of each group along ``order`` (1-based); the order must be total."""
    rows = _blocks(df, group, order)
    totals = rows.groupBy(*group, "_block").agg(
        F.count(F.lit(1)).alias("_total"), F.min("_mid").alias("_block_start"))
    offsets = _block_offsets(totals, group)
    numbered = _join_offsets(rows, offsets, group)
    return numbered.withColumn(
        out, (F.coalesce("_before", F.lit(0)) + F.col("_mid") - F.col("_block_start") + 1).cast("bigint")
    ).select(*df.columns, out)


def running_total(df: DataFrame, group: list[str], order: list, value: str, out: str) -> DataFrame:
    """Sum of ``value`` up to and including the row, per group along ``order``; missing values add nothing.

    It is missing until the first value that is there, wherever the blocks begin.
    """
    rows = _blocks(df, group, order)
    totals = rows.groupBy(*group, "_block").agg(F.sum(value).alias("_total"))
    offsets = _block_offsets(totals, group)
    inside = Window.partitionBy(*group, "_block").orderBy("_mid").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    within = rows.withColumn("_inside", F.sum(value).over(inside))
    return _join_offsets(within, offsets, group).withColumn(
        out, F.when(F.col("_inside").isNotNull() | F.col("_before").isNotNull(),
                    F.coalesce("_before", F.lit(0)) + F.coalesce("_inside", F.lit(0)))).select(*df.columns, out)


#: Buckets of the first count per doubling of the value, and of the second within one of these.
_PER_DOUBLING, _FINER = 512, 4096


def _size_bucket(v: Column) -> Column:
    """Bucket that grows with the value: sign and logarithm; infinite values and NaN, the largest, have their own."""
    size = F.floor(F.log2(F.abs(v)) * _PER_DOUBLING) + 1100 * _PER_DOUBLING
    last = F.lit(2200 * _PER_DOUBLING)
    return F.when(F.isnan(v), last + 1).when(v == float("inf"), last).when(v == float("-inf"), -last).when(v == 0, F.lit(0)).otherwise(
        F.when(v > 0, size).otherwise(-size)).cast("bigint")


def ranges(counts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Counts with the ranks before them, in their key."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1) if keys else \
        Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def beside(rows: DataFrame, asked: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows joined with what is asked in their key; null keys match null keys."""
    right = asked.select(*[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)], *columns)
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{i}"))
    return rows.join(right, on).drop(*[f"_k_{i}" for i in range(len(keys))])


def quantiles(df: DataFrame, group: list[str], value: str, probs: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation between order statistics.

    One row per group and probability.  All groups and ranks are selected together by three counts that combine on the
    map side: by size in buckets of a 512th of a doubling, by 4,096 parts of the buckets that hold a wanted rank, and by
    value in the parts that hold one.  A bucket of one value needs no further count.  Nothing is sorted but counts, so a
    value that fills a large part of the data is one row, and no table is written.
    """
    rows = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("_v"))
    rows = rows.withColumn("_b", _size_bucket(F.col("_v")))
    count = [F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    first = ranges(rows.groupBy(*group, "_b").agg(*count), group, "_b").withColumn("_size", F.sum("_n").over(whole))
    wanted = []
    for i, p in enumerate(probs):
        h = (F.col("_size") - 1) * F.lit(float(p))
        wanted += [F.struct(F.lit(i).alias("q_id"), F.lit(float(p)).alias("prob"), (h - F.floor(h)).alias("f"), F.lit(side).alias("side"),
                            rank.cast("bigint").alias("rank")) for side, rank in ((0, F.floor(h)), (1, F.ceil(h)))]
    mine = F.filter(F.array(*wanted), lambda a: (a["rank"] >= F.col("_from")) & (a["rank"] < F.col("_from") + F.col("_n")))
    found = first.select(*group, "_b", "_lo", "_hi", "_from", F.explode(mine).alias("a")).select(
        *group, "_b", "_lo", "_hi", "a.q_id", "a.prob", "a.f", "a.side", (F.col("a.rank") - F.col("_from")).alias("_rank"))
    told = ["q_id", "prob", "f", "side"]
    single = F.col("_lo").eqNullSafe(F.col("_hi"))
    answers = [found.where(single).select(*group, *told, F.col("_lo").alias("_a"))]

    keys = [*group, "_b"]
    left = found.where(~single)
    ends = left.select(*keys, "_lo", "_hi").distinct()
    part = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * _FINER).cast("bigint")
    inside = beside(rows, ends, keys, ["_lo", "_hi"]).select(*keys, "_v", part.alias("_p"))
    finer = ranges(inside.groupBy(*keys, "_p").agg(*count), keys, "_p")
    held = (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_n"))
    found = beside(finer, left, keys, [*told, "_rank"]).where(held).withColumn("_rank", F.col("_rank") - F.col("_from"))
    answers.append(found.where(single).select(*group, *told, F.col("_lo").alias("_a")))

    left, keys = found.where(~single), [*keys, "_p"]
    values = beside(inside, left.select(*keys).distinct(), keys, []).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    last = beside(ranges(values, keys, "_v"), left, keys, [*told, "_rank"]).where(held)
    answers.append(last.select(*group, *told, F.col("_v").alias("_a")))
    both = answers[0].unionByName(answers[1]).unionByName(answers[2]).groupBy(*group, "q_id", "prob").agg(
        F.max("f").alias("_f"), F.max(F.when(F.col("side") == 0, F.col("_a"))).alias("_a"), F.max(F.when(F.col("side") == 1, F.col("_a"))).alias("_b"))
    between = F.when(F.col("_a").eqNullSafe(F.col("_b")) | (F.col("_f") == 0), F.col("_a")).otherwise(F.col("_a") + F.col("_f") * (F.col("_b") - F.col("_a")))
    return both.select(*group, "q_id", "prob", between.alias("quantile"))


def appearance_codes(df: DataFrame, category: str, order: str, out: str) -> DataFrame:
    """Integer code of each category in order of its first appearance along ``order``."""
    firsts = df.groupBy(category).agg(F.min(order).alias("_appears"))
    return row_numbers(firsts, [], ["_appears", category], out).select(category, out)
