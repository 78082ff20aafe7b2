"""Histograms and kernel densities on grids of bounded size.

Values are first counted into grid nodes, each shared between its two neighbours; only the
nodes meet the output grid.  The work after that count does not depend on the number of rows.
"""

from __future__ import annotations

import math
import sys
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtrace.functions.nullsafe import col
from fieldtrace.operators.keyed import ROWS, attach_per_key
from fieldtrace.operators.ranks import beside, quantiles, ranges
from fieldtrace.sources.store import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bandwidths after which the normal kernel, below 1e-15 of its peak, no longer changes a sum of doubles.
_REACH = 8.5
#: Parts of a group's range in which its values are counted; groups whose arrays, and rows that a task holds at once.
_CELLS, _GROUPS_HELD, _ROWS_GATHERED = 4096, 1024, 1 << 21


def histogram(df: DataFrame, group: list[str], value: str, weight: str | None = None, *, bins: int | None = None,
              binwidth: float | None = None, boundary: float = 0.0, log10: bool = False) -> DataFrame:
    """Weighted histogram with a common scale for all groups.

    Bins are closed on the right, the first one on both sides.  With ``bins`` the width is the
    range over ``bins - 1``.  Gives the bin number, its lower end, the sum of weights and the
    density, which adds up to 1 per group.
    """
    x = F.log10(col(value)) if log10 else col(value).cast("double")
    w = F.lit(1.0) if weight is None else col(weight).cast("double")
    rows = df.select(*group, x.alias("_x"), w.alias("_w")).where(F.col("_x").isNotNull())
    ends = rows.agg(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi")).alias("e")).scalar()
    spread = ends["hi"] - ends["lo"]  # values that are all equal fill one bin of width 1
    width = F.lit(float(binwidth)) if binwidth else F.when(spread > 0, spread / (bins - 1)).otherwise(F.lit(1.0))
    origin = boundary + F.floor((ends["lo"] - boundary) / width) * width
    place = F.greatest(F.ceil((F.col("_x") - origin) / width) - 1, F.lit(0)).cast("bigint")
    counted = rows.groupBy(*group, place.alias("bin")).agg(F.sum("_w").alias("weight"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))  # one row per bin
    return counted.select(*group, "bin", (origin + F.col("bin") * width).alias("low"), "weight",
                          (F.col("weight") / (F.sum("weight").over(whole) * width)).alias("density"))


def rule_of_thumb(df: DataFrame, group: list[str], value: str, adjust: float = 1.0, factor: float = 0.9) -> DataFrame:
    """Bandwidth ``factor * min(sd, IQR / 1.34) * n ** -0.2`` per group, with range and row count."""
    sums = df.groupBy(*group).agg(
        F.count(value).alias("n"), F.count(F.lit(1)).alias(ROWS), F.stddev_samp(value).alias("sd"),
        F.min(value).alias("lo"), F.max(value).alias("hi"))
    q = quantiles(df, group, value, [0.25, 0.75]).groupBy(*group).agg(
        (F.max("quantile") - F.min("quantile")).alias("iqr"))
    return _thumb(sums, q, group, factor * adjust)


def _thumb(sums: DataFrame, q: DataFrame, group: list[str], factor: float) -> DataFrame:
    joined = attach_per_key(sums, q, group)
    spread = F.least("sd", F.col("iqr") / 1.34)
    spread = F.when(spread > 0, spread).when(F.col("sd") > 0, F.col("sd")).when(F.col("lo") != 0, F.abs("lo")).otherwise(F.lit(1.0))
    return joined.select(*group, ROWS, "n", "lo", "hi", (F.lit(factor) * spread * F.pow(F.col("n"), F.lit(-0.2))).alias("bw"))


def _known(df: DataFrame, *columns: str | None) -> DataFrame:
    """Rows that can add to a density: value and weight are there."""
    return df.where(reduce(and_, [F.col(c).isNotNull() for c in columns if c is not None]))


def _per_group(rows: DataFrame, per: DataFrame, group: list[str]) -> DataFrame:
    """One row per group brought to the rows of a grid, which has few per group."""
    return attach_per_key(rows, per, group, "inner")


def _nodes(n: int) -> int:
    return 512 if n <= 512 else 2 ** math.ceil(math.log2(n))


def _binned(df: DataFrame, group: list[str], value: str, weight: str | None, nodes: int) -> DataFrame:
    """Mass per grid node; ``df`` carries bw, x_from and x_to.  The grid overhangs by 4 bandwidths."""
    w = F.lit(1.0) if weight is None else col(weight).cast("double")
    lo = F.col("x_from") - 4 * F.col("bw")
    step = (F.col("x_to") - F.col("x_from") + 8 * F.col("bw")) / (nodes - 1)
    at = (F.col(value) - lo) / step
    rows = df.where(F.col(value).isNotNull()).select(
        *group, "bw", "x_from", "x_to", F.floor(at).alias("_i"), (at - F.floor(at)).alias("_f"), w.alias("_w"))
    both = F.explode(F.array(
        F.struct(F.col("_i").alias("i"), (F.col("_w") * (1 - F.col("_f"))).alias("m")),
        F.struct((F.col("_i") + 1).alias("i"), (F.col("_w") * F.col("_f")).alias("m"))))
    parts = rows.select(*group, "bw", "x_from", "x_to", both.alias("_p")).where(F.col("_p.i").between(0, nodes - 1))
    return parts.groupBy(*group, "bw", "x_from", "x_to", F.col("_p.i").alias("_i")).agg(F.sum("_p.m").alias("_m"))


def _spread(binned: DataFrame, n: int, nodes: int) -> DataFrame:
    """Every node with the output points in reach and its share of their density."""
    bw, step = F.col("bw"), (F.col("x_to") - F.col("x_from") + 8 * F.col("bw")) / (nodes - 1)
    out_step = (F.col("x_to") - F.col("x_from")) / (n - 1)
    centre = (F.col("_i") * step - 4 * bw) / out_step
    reach = (_REACH * bw + step) / out_step
    ks = F.sequence(F.greatest(F.lit(0), F.floor(centre - reach)).cast("int"),
                    F.least(F.lit(n - 1), F.ceil(centre + reach)).cast("int"))
    met = binned.where((centre + reach >= 0) & (centre - reach <= n - 1)).select("*", F.explode(ks).alias("k"))
    # the density at an output point is interpolated between the two nodes around it
    at = (F.col("k") * out_step + 4 * bw) / step
    j, f = F.floor(at), at - F.floor(at)
    kernel = lambda z: F.exp(-0.5 * z * z) / (bw * math.sqrt(2 * math.pi))
    y = F.col("_m") * ((1 - f) * kernel((j - F.col("_i")) * step / bw) + f * kernel((j + 1 - F.col("_i")) * step / bw))
    return met.withColumns({"x": F.col("x_from") + F.col("k") * out_step, "_y": y})


def kernel_density(df: DataFrame, group: list[str], value: str, weight: str | None = None, *, n: int = 512,
                   bw: float | None = None, adjust: float = 1.0, span: tuple[float, float] | None = None) -> DataFrame:
    """Weighted normal-kernel density on ``n`` points per group; weights count as shares, of a sum of 0 there are none.

    Without ``bw`` the rule of thumb of the unweighted values applies; without ``span`` the grid
    runs three bandwidths beyond the data.
    """
    df, nodes = _known(df, value, weight), _nodes(n)
    params = rule_of_thumb(df, group, value, adjust)
    if bw is not None:
        params = params.withColumn("bw", F.lit(float(bw)))
    ends = (F.lit(float(span[0])), F.lit(float(span[1]))) if span else (F.col("lo") - 3 * F.col("bw"), F.col("hi") + 3 * F.col("bw"))
    params = params.select(*group, ROWS, "bw", ends[0].alias("x_from"), ends[1].alias("x_to"))
    rows = attach_per_key(df, params, group, "inner")
    masses = rows.groupBy(*group).agg(F.sum(F.lit(1.0) if weight is None else F.col(weight)).alias("_whole"))
    y = _spread(_binned(rows, group, value, weight, nodes), n, nodes).groupBy(*group, "k", "x").agg(F.sum("_y").alias("_y"))
    return _per_group(y, masses, group).select(*group, F.col("k").alias("point"), "x", F.try_divide("_y", "_whole").alias("density"))


def circular_density(df: DataFrame, group: list[str], angle: str, weight: str | None = None, bw: float = 12.0,
                     n: int = 1000) -> DataFrame:
    """Density of angles in degrees: three copies a full turn apart, cut to -180..180, shares of 1; missing for weights of 0."""
    df = _known(df, angle, weight)
    shift = F.explode(F.array(F.lit(-360.0), F.lit(0.0), F.lit(360.0)))
    copies = df.select("*", shift.alias("_turn")).withColumn(angle, F.col(angle) + F.col("_turn")).drop("_turn")
    ends = df.groupBy(*group).agg(F.count(F.lit(1)).alias(ROWS), F.min(angle).alias("lo"), F.max(angle).alias("hi"))
    params = ends.select(*group, (F.col(ROWS) * 3).alias(ROWS), F.lit(float(bw)).alias("bw"),
                         (F.col("lo") - 360 - 3 * bw).alias("x_from"), (F.col("hi") + 360 + 3 * bw).alias("x_to"))
    rows = attach_per_key(copies, params, group, "inner")
    nodes = _nodes(n)
    y = _spread(_binned(rows, group, angle, weight, nodes), n, nodes).groupBy(*group, "k", "x").agg(F.sum("_y").alias("_y"))
    shown = y.where(F.col("x").between(-180, 180))
    whole = Window.partitionBy(*(group or [F.lit(0)]))  # at most n rows per group
    return shown.select(*group, F.col("k").alias("point"), F.col("x").alias("angle_deg"),
                        F.try_divide(F.col("_y"), F.sum("_y").over(whole)).alias("density"))


def _fields(df: DataFrame, group: list[str], **more: T.DataType) -> T.StructType:
    return T.StructType([*(df.schema[g] for g in group), *(T.StructField(c, t) for c, t in more.items())])


def gathered_values(df: DataFrame, group: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Written rows of a group's values that met in one task: the different ones in rising order (``x``), their weights added
    up (``w``) and their numbers (``n``).

    A task gathers ``_ROWS_GATHERED`` rows at most before it lets go of them, so neither large nor many groups are held whole.
    """
    rows = _known(df, value, weight).select(*group, F.col(value).cast("double").alias("x"), (F.lit(1.0) if weight is None else col(weight).cast("double")).alias("w"))

    def told(held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held).combine_chunks()
        code, x, w = np.zeros(table.num_rows, np.int64), table["x"].to_numpy(), table["w"].to_numpy()
        for g in group:
            named = table[g].combine_chunks().dictionary_encode("encode")
            _, code = np.unique(code * len(named.dictionary) + named.indices.to_numpy(), return_inverse=True)
        if len(code) and code.max() < 1 << 15:
            code = code.astype(np.int16)
        order = np.argsort(x)
        order = order[np.argsort(code[order], kind="stable")]
        code, x, w = code[order], x[order], w[order]
        begins = np.append(True, code[1:] != code[:-1])
        first = np.flatnonzero(begins | np.append(True, x[1:] != x[:-1]))
        cuts = pa.array(np.append(np.flatnonzero(begins[first]), len(first)).astype(np.int32))
        n = np.diff(np.append(first, len(x))).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [*(table[g].combine_chunks().take(pa.array(order[begins])) for g in group),
             *(pa.ListArray.from_arrays(cuts, pa.array(v)) for v in (x[first], np.add.reduceat(w, first), n))], names=[*group, "x", "w", "n"])

    def gather(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= _ROWS_GATHERED:
                yield told(held)
                held, size = [], 0
        if size:
            yield told(held)

    many = {"x": T.ArrayType(T.DoubleType()), "w": T.ArrayType(T.DoubleType()), "n": T.ArrayType(T.IntegerType())}
    return staged(rows.mapInArrow(gather, _fields(rows, group, **many)), compression="zstd")


def _numbers(batch: pa.RecordBatch, column: str, row: int) -> np.ndarray:
    return batch.column(column)[row].values.to_numpy(zero_copy_only=False)


def _grid_sums(gathered: DataFrame, group: list[str], cells: int, place) -> DataFrame:
    """Amounts per cell of a group's grid, in a row per group and task: the cells that are met (``at``) and their sums.

    ``place(batch, row)`` gives cells, which may lie outside, and amounts of the values of a row.  A task holds
    ``_GROUPS_HELD`` groups at most.
    """
    def add(batches):
        held: dict[tuple, np.ndarray] = {}

        def told(types):
            met = [np.flatnonzero(x) for x in held.values()]
            cuts = pa.array(np.append(0, np.cumsum([len(x) for x in met])).astype(np.int32))
            sums = [x[i] for x, i in zip(held.values(), met)]
            out = [*(pa.array([k[j] for k in held], t) for j, t in enumerate(types)),
                   pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(met).astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(sums)))]
            held.clear()
            return pa.RecordBatch.from_arrays(out, names=[*group, "at", "sums"])

        for batch in batches:
            types = [batch.schema.field(g).type for g in group]
            keys = zip(*(batch.column(g).to_pylist() for g in group)) if group else [()] * batch.num_rows
            for row, key in enumerate(keys):
                at, amount = place(batch, row)
                inside = (at >= 0) & (at < cells)
                mine = np.bincount(at[inside].astype(np.int64), amount[inside], cells)
                held[key] = held[key] + mine if key in held else mine
                if len(held) > _GROUPS_HELD:
                    yield told(types)
        if held:
            yield told(types)

    return gathered.mapInArrow(add, _fields(gathered, group, at=T.ArrayType(T.IntegerType()), sums=T.ArrayType(T.DoubleType())))


def _whole(parts: pa.Table, cells: int) -> np.ndarray:
    """Sums of all rows of a group."""
    at, sums = (parts[c].combine_chunks().flatten().to_numpy() for c in ("at", "sums"))
    return np.bincount(at, sums, cells)


def _cells(x: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Part of the range lo..hi that holds each value."""
    with np.errstate(invalid="ignore"):
        return np.nan_to_num(np.minimum(np.floor((x - lo) / (hi - lo if hi > lo else 1.0) * _CELLS), _CELLS - 1), nan=0.0)


def _extent(gathered: DataFrame, group: list[str]) -> DataFrame:
    """Number, mean square deviation and ends of the values of each group."""
    def add(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for row in range(batch.num_rows):
                x, n = _numbers(batch, "x", row), _numbers(batch, "n", row)
                mean = np.average(x, weights=n)
                out.append((n.sum(), mean, (n * (x - mean) ** 2).sum(), x.min(), x.max()))
            yield pa.RecordBatch.from_arrays([*(batch.column(g) for g in group), *(pa.array(v) for v in zip(*out))], names=[*group, "n", "mean", "m2", "lo", "hi"])

    number = T.DoubleType()
    parts = gathered.mapInArrow(add, _fields(gathered, group, n=T.LongType(), mean=number, m2=number, lo=number, hi=number))
    whole = parts.groupBy(*group).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                                      F.collect_list(F.struct("n", "mean", "m2")).alias("_p"))  # one per task
    square = F.aggregate("_p", F.lit(0.0), lambda s, p: s + p["m2"] + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")))
    return whole.select(*group, "n", F.col("n").alias(ROWS), F.when(F.col("n") > 1, F.sqrt(square / (F.col("n") - 1))).alias("sd"), "lo", "hi")


def _quartiles_apart(gathered: DataFrame, sums: DataFrame, group: list[str]) -> DataFrame:
    """Exact distance of the quartiles per group, for many groups of many rows.

    Values are counted in ``_CELLS`` parts of the group's range, in one array per group; then those in the few cells that
    hold a wanted rank are counted by value.
    """
    placed = attach_per_key(gathered.select(*group, "x", "n"), sums.select(*group, ROWS, "lo", "hi"), group, "inner")

    def cells_of(batch, row):
        return _cells(_numbers(batch, "x", row), *(batch.column(c)[row].as_py() for c in ("lo", "hi"))), _numbers(batch, "n", row)

    def seek(parts: pa.Table) -> pa.Table:
        upto = np.cumsum(_whole(parts, _CELLS))
        h = (upto[-1] - 1) * np.array([0.25, 0.25, 0.75, 0.75])
        rank = np.where([True, False, True, False], np.floor(h), np.ceil(h))
        at = np.searchsorted(upto, rank, "right")
        return pa.table({**{g: pa.array([parts[g][0].as_py()] * 4, parts.schema.field(g).type) for g in group}, "side": pa.array([0, 1, 2, 3]), "f": pa.array(h - np.floor(h)),
                         "_i": pa.array(at), "_rank": pa.array((rank - np.append(0, upto)[at]).astype(np.int64))})

    long, number = T.LongType(), T.DoubleType()
    asked = staged(_grid_sums(placed, group, _CELLS, cells_of).groupBy(*group).applyInArrow(seek, _fields(gathered, group, side=long, f=number, _i=long, _rank=long)))

    def pick(batches):
        for batch in batches:
            picked = []
            for row in range(batch.num_rows):
                x, n, wanted = (_numbers(batch, c, row) for c in ("x", "n", "_wanted"))
                cell = _cells(x, *(batch.column(c)[row].as_py() for c in ("lo", "hi")))
                there = np.flatnonzero(np.isin(cell, wanted))
                picked.append((np.full(len(there), row), cell[there].astype(np.int64), x[there], n[there].astype(np.int64)))
            if picked:
                of, *found = (np.concatenate(v) for v in zip(*picked))
                yield pa.RecordBatch.from_arrays([*(batch.column(g).take(pa.array(of)) for g in group), *(pa.array(v) for v in found)], names=[*group, "_i", "_v", "_n"])

    keys = [*group, "_i"]
    wanted = asked.groupBy(*group).agg(F.collect_set("_i").alias("_wanted"), F.count(F.lit(1)).alias(ROWS))  # four at most
    values = attach_per_key(placed, wanted, group, "inner").mapInArrow(pick, _fields(gathered, group, _i=long, _v=number, _n=long)).groupBy(*keys, "_v").agg(F.sum("_n").alias("_n"))
    met = beside(ranges(values, keys, "_v"), asked, keys, ["side", "f", "_rank"]).where(
        (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_n")))
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("_v")))
    share = lambda side: F.max(F.when(F.col("side") == side, F.col("f")))
    return met.groupBy(*group).agg((of(2) + share(2) * (of(3) - of(2)) - of(0) - share(0) * (of(1) - of(0))).alias("iqr"))


def positive_share(df: DataFrame, group: list[str], value: str, weight: str | None = None, n: int = 512) -> DataFrame:
    """Share of the density on -1..1 that lies above zero, per group (rule-of-thumb bandwidth).

    ``df`` is read once, its values are written in arrays.
    """
    return share_of_gathered(gathered_values(df, group, value, weight), group, n)


def share_of_gathered(gathered: DataFrame, group: list[str], n: int = 512) -> DataFrame:
    """``positive_share`` of what ``gathered_values`` wrote; the values of a row may be in any order and repeat.

    Rows are read four times.  Each time a task keeps one row or array per group that it meets, so what is shuffled does
    not grow with the values; where rows of a group lie in few tasks it is least.
    """
    nodes = _nodes(n)
    sums = staged(_extent(gathered, group))
    params = staged(_thumb(sums, _quartiles_apart(gathered, sums, group), group, 0.9).select(*group, ROWS, "bw"))

    def nodes_of(batch, row):
        x, w, bw = _numbers(batch, "x", row), _numbers(batch, "w", row), batch.column("bw")[row].as_py()
        at = (x + 1 + 4 * bw) / ((2 + 8 * bw) / (nodes - 1))
        low = np.floor(at)
        return np.append(low, low + 1), np.append(w * (1 - (at - low)), w * (at - low))

    placed = attach_per_key(gathered.select(*group, "x", "w"), params, group, "inner")
    masses = attach_per_key(_grid_sums(placed, group, nodes, nodes_of), params, group, "inner")

    def spread(parts: pa.Table) -> pa.Table:
        mass = _whole(parts, nodes)
        bw = parts["bw"][0].as_py()
        step = (2 + 8 * bw) / (nodes - 1)
        z = np.arange(1 - nodes, nodes) * (step / bw)
        y = np.convolve(mass, np.exp(-0.5 * z * z))[nodes - 1:2 * nodes - 1]  # at the nodes; between them in proportion
        x = -1 + np.arange(n) * (2 / (n - 1))
        shown = np.interp((x + 1 + 4 * bw) / step, np.arange(nodes), y)
        whole = shown.sum()
        return pa.table({**{g: parts[g].slice(0, 1) for g in group}, "prop": pa.array([shown[x > 0].sum() / whole if whole != 0 else None], pa.float64())})

    return masses.groupBy(*group).applyInArrow(spread, _fields(gathered, group, prop=T.DoubleType()))


def _share(at: Column) -> Column:
    return F.array(F.struct(F.floor(at).cast("int").alias("i"), (1 - (at - F.floor(at))).alias("f")),
                   F.struct((F.floor(at) + 1).cast("int").alias("i"), (at - F.floor(at)).alias("f")))


def density_2d(df: DataFrame, group: list[str], x: str, y: str, box: tuple[tuple[float, float], tuple[float, float]],
               points: int = 100, refine: int = 4, levels=(0.01, 0.1, 0.5, 0.8, 1.0)) -> DataFrame:
    """Density on a grid over ``box``, relative to the largest cell of the group, with its class.

    Points count into a grid ``refine`` times finer; the normal kernel is applied along x and
    then along y.  ``level`` is the largest level reached, null below the first.
    """
    if not group:
        return density_2d(df.withColumn("_all", F.lit(1)), ["_all"], x, y, box, points, refine, levels).drop("_all")
    inside = F.col(x).between(box[0][0], box[1][0]) & F.col(y).between(box[0][1], box[1][1])
    rows = df.where(inside)
    bx = rule_of_thumb(rows, group, x, factor=1.06).select(*group, ROWS, F.col("bw").alias("bx"))
    by = rule_of_thumb(rows, group, y, factor=1.06).select(*group, F.col("bw").alias("by"))
    params = _per_group(bx, by, group)
    last = (points - 1) * refine
    sx, sy = (box[1][0] - box[0][0]) / last, (box[1][1] - box[0][1]) / last
    placed = attach_per_key(rows, params, group, "inner").select(
        *group, "bx", "by", F.explode(_share((F.col(x) - box[0][0]) / sx)).alias("a"),
        ((F.col(y) - box[0][1]) / sy).alias("_aty"))
    binned = placed.select(*group, "bx", "by", "a", F.explode(_share(F.col("_aty"))).alias("b")).groupBy(
        *group, "bx", "by", F.col("a.i").alias("ix"), F.col("b.i").alias("iy")).agg(F.sum(F.col("a.f") * F.col("b.f")).alias("m"))

    def along(src: DataFrame, i: str, k: str, step: float, bw: str, keep: list[str]) -> DataFrame:
        reach = _REACH * F.col(bw) / step
        ks = F.sequence(F.greatest(F.lit(0), F.floor((F.col(i) - reach) / refine)).cast("int"),
                        F.least(F.lit(points - 1), F.ceil((F.col(i) + reach) / refine)).cast("int"))
        met = src.select("*", F.explode(ks).alias(k))
        z = (F.col(k) * refine - F.col(i)) * step / F.col(bw)
        return met.groupBy(*group, "bx", "by", *keep, k).agg(
            F.sum(F.col("m") * F.exp(-0.5 * z * z) / F.col(bw)).alias("m"))

    cells = along(along(binned, "ix", "kx", sx, "bx", ["iy"]), "iy", "ky", sy, "by", ["kx"])
    whole = Window.partitionBy(*(group or [F.lit(0)]))  # one row per grid cell
    rel = F.col("m") / F.max("m").over(whole)
    level = F.lit(None).cast("double")
    for lv in sorted(levels, reverse=True):
        level = F.when(F.col("ndensity") >= lv, F.lit(float(lv))).otherwise(F.lit(None)) if lv == max(levels) else F.coalesce(
            level, F.when(F.col("ndensity") >= lv, F.lit(float(lv))))
    return cells.select(*group, "kx", "ky", rel.alias("ndensity")).withColumn("level", level)
