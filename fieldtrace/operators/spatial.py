"""Points, polygons as edge rows, nearest features and clusters.

A polygon is its edges ``(poly, x1, y1, x2, y2)``.  Joins run on grid cells, so a point meets
only the edges around it, and distinct positions are handled once however many records they have.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from fieldtrace.functions.geo import (
    EARTH_RADIUS_KM, box_distance_floor_km, crossing, distance_km, planar_edge_distance, segment_distance_km,
)
from fieldtrace.operators.joins import union_all
from fieldtrace.operators.keyed import ROWS, attach_per_key
from fieldtrace.operators.ranks import row_numbers
from fieldtrace.sources.store import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_FAN = 32  # edges of a leaf and children of a node in the nearest search
_TOGETHER = 32  # neighbouring positions that go down the tree as one row
_RUNS_A_TASK, _PAIRS_A_TASK = 512, 4096  # such runs that a task takes down the tree, and runs with a leaf that it measures


def _cell(c: Column | str, size: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / size)


def covering_polygons(points: DataFrame, edges: DataFrame, poly: str, x: str = "lon", y: str = "lat",
                      cell: float = 1.0) -> DataFrame:
    """Distinct positions with each polygon that holds them (left and lower border inside).

    A polygon's edges are filed under every cell of its bounding box in the edge's own rows of
    cells; the parity of the edges to the right of a point decides.  A point meets those edges of its cell that span its
    height and whose polygon reaches it, so what is counted grows with the polygons that hold it, not with the cell.
    """
    spots = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y).distinct()
    # few bytes meet many edges in a cell: the cells are dealt to all tasks, which bytes alone would put into one
    spots = spots.withColumns({"_cx": _cell(x, cell), "_cy": _cell(y, cell)}).repartition(
        int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_cx", "_cy")
    width = edges.groupBy(poly).agg(
        F.min(F.least("x1", "x2")).alias("_xa"), F.max(F.greatest("x1", "x2")).alias("_xb"))
    rows = edges.where(F.col("y1") != F.col("y2")).withColumn(
        "_cy", F.explode(F.sequence(_cell(F.least("y1", "y2"), cell), _cell(F.greatest("y1", "y2"), cell))))
    filed = rows.join(width, poly).withColumn(
        "_cx", F.explode(F.sequence(_cell("_xa", cell), _cell("_xb", cell)))
    ).select(poly, "x1", "y1", "x2", "y2", "_xa", "_xb", "_cx", "_cy")
    reached = ((F.col("y1") > F.col(y)) != (F.col("y2") > F.col(y))) & F.col(x).between(F.col("_xa"), F.col("_xb"))
    crossed = spots.join(filed, ["_cx", "_cy"]).where(reached).groupBy(x, y, poly).agg(
        F.sum(crossing(x, y, "x1", "y1", "x2", "y2")).alias("_n"))
    return crossed.where(F.col("_n") % 2 == 1).select(x, y, poly)


def join_covering(points: DataFrame, edges: DataFrame, poly: str, x: str = "lon", y: str = "lat",
                  cell: float = 1.0, uid: str = "id") -> DataFrame:
    """Every point with the polygons that hold it, one row each, or null when none does."""
    held = covering_polygons(points, edges, poly, x, y, cell).groupBy(x, y).agg(
        F.collect_list(poly).alias("_polys"))
    sized = points.groupBy(x, y).agg(F.count(F.lit(1)).alias(ROWS)).join(held, [x, y])
    return attach_per_key(points, sized, [x, y], "left").select(
        *points.columns, F.explode_outer("_polys").alias(poly))


def label_near_site(lon, lat, label, site: tuple[float, float], km: float, name: str) -> Column:
    """Replace a label by ``name`` within ``km`` of a site."""
    d = distance_km(lon, lat, F.lit(site[0]), F.lit(site[1]))
    near = F.abs(F.col(lat) - site[1]) <= km / 110.0
    return F.when(near & (d <= km), F.lit(name)).otherwise(F.col(label) if isinstance(label, str) else label)


def _z_order(x: Column, y: Column) -> Column:
    """Place of a longitude and latitude along a curve through the quadrants, their quadrants and so on, 26 times."""
    def spread(v: Column) -> Column:
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    def steps(v: Column, low: float, width: float) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(2**26 - 1), F.floor((v - low) * (2**26 / width)))).cast("bigint")

    return spread(steps(x, -180.0, 360.0)).bitwiseOR(F.shiftleft(spread(steps(y, -90.0, 180.0)), 1))


def _packed_tree(edges: DataFrame, feature: str, group: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """Edges in leaves of ``_FAN`` neighbours, and for each level the nodes with their children, the leaves' parents first.

    Leaves are runs along the curve through the quadrants, nodes are runs of children.  So every node but the last of
    a level is full however the edges lie, and a dense place simply has more, smaller nodes.  The last level has one
    node per group, with ``_FAN`` children at most.
    """
    placed = edges.withColumns({"_mx": (F.col("x1") + F.col("x2")) / 2, "_my": (F.col("y1") + F.col("y2")) / 2}).withColumns({
        "_z": _z_order(F.col("_mx"), F.col("_my")),
        "_half": F.greatest(distance_km("_mx", "_my", "x1", "y1"), distance_km("_mx", "_my", "x2", "y2"))})
    numbered = row_numbers(placed.select(*group, feature, "x1", "y1", "x2", "y2", "_mx", "_my", "_half", "_z"), group,
                           ["_z", "x1", "y1", "x2", "y2", feature], "_n")
    box = [F.min("_mx").alias("xa"), F.min("_my").alias("ya"), F.max("_mx").alias("xb"), F.max("_my").alias("yb"),
           F.max("_half").alias("half"), F.min(F.struct("x1", "y1")).alias("rep")]
    leaves = staged(numbered.groupBy(*group, F.floor((F.col("_n") - 1) / _FAN).alias("_node")).agg(
        F.collect_list(F.struct(F.col(feature).alias("f"), "x1", "y1", "x2", "y2")).alias("_edges"), *box))
    levels, below, last = [], leaves.drop("_edges"), leaves.agg(F.coalesce(F.max("_node"), F.lit(0))).first()[0]
    names = ["xa", "ya", "xb", "yb", "half", "rep"]
    while True:
        up = below.groupBy(*group, F.floor(F.col("_node") / _FAN).alias("_up")).agg(
            F.collect_list(F.struct(F.col("_node").alias("id"), *names)).alias("_children"),
            *[F.min(c).alias(c) for c in ("xa", "ya", "rep")], *[F.max(c).alias(c) for c in ("xb", "yb", "half")]).withColumnRenamed("_up", "_node")
        levels.append(up.select(*group, "_node", "_children"))
        if last < _FAN:
            return leaves, levels
        below, last = staged(up.drop("_children")), last // _FAN


def _position_blocks(spots: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Positions in runs of ``_TOGETHER`` neighbours: their middle, and the distance of the farthest one from it."""
    numbered = row_numbers(spots.withColumn("_z", _z_order(F.col(x), F.col(y))), group, ["_z", x, y], "_n")
    middle = lambda c: ((F.min(c) + F.max(c)) / 2).alias(f"_m{c}")
    at = numbered.select(*group, F.floor((F.col("_n") - 1) / _TOGETHER).alias("_block"), F.col(x).alias("x"), F.col(y).alias("y"))
    runs = at.groupBy(*group, "_block").agg(F.collect_list(F.struct("x", "y")).alias("_at"), middle("x"), middle("y"))
    far = F.array_max(F.transform("_at", lambda p: distance_km("_mx", "_my", p["x"], p["y"])))
    return runs.select(*group, "_block", "_mx", "_my", far.alias("_far"), F.col("_at.x").alias("_xs"), F.col("_at.y").alias("_ys"))


def _unit_vectors(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    lon, lat = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])


def _chord_km(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 2 * EARTH_RADIUS_KM * np.arcsin(np.minimum(1.0, np.sqrt(((a - b) ** 2).sum(axis=0)) / 2))


def _segment_km(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all points from all segments, as ``segment_distance_km``; points and ends are columns of unit vectors."""
    n = np.cross(a, b, axis=0)
    length = np.sqrt((n * n).sum(axis=0))
    ends = np.minimum(*(_chord_km(p[:, :, None], e[:, None, :]) for e in (a, b)))
    if not (length > 1e-15).any():
        return ends
    beside = (p.T @ np.cross(n, a, axis=0) > 0) & (p.T @ np.cross(b, n, axis=0) > 0) & (length > 1e-15)
    across = EARTH_RADIUS_KM * np.arcsin(np.minimum(1.0, np.abs(p.T @ n) / np.where(length > 1e-15, length, 1.0)))
    return np.where(beside, across, ends)


def _measured(group: list[str], names: list[str]):
    """Task of the nearest search: the nearest edge of a leaf for each position of a run, the first among equals.

    Edges that are too far from the middle of the run, as nodes are in the tree, are left out first.
    """
    def measure(batches):
        for batch in batches:
            column = {c: batch.column(c) for c in batch.schema.names}
            ends = column["_edges"].flatten()
            x1, y1, x2, y2 = (ends.field(c).to_numpy(zero_copy_only=False) for c in ("x1", "y1", "x2", "y2"))
            xs, ys = (column[c].flatten().to_numpy(zero_copy_only=False) for c in ("_xs", "_ys"))
            n_at, n_edges = (pc.list_value_length(column[c]).to_numpy() for c in ("_xs", "_edges"))
            p, a, b = _unit_vectors(xs, ys), _unit_vectors(x1, y1), _unit_vectors(x2, y2)
            row = np.repeat(np.arange(batch.num_rows), n_edges)
            middle = _unit_vectors(*(column[c].to_numpy() for c in ("_mx", "_my")))[:, row]
            along = (a + b) / np.maximum(np.sqrt(((a + b) ** 2).sum(axis=0)), 1e-300)
            floor = _chord_km(middle, along) - _chord_km(a, b) / 2
            near = np.flatnonzero(~(floor > column["_reach"].to_numpy()[row] + 1e-6))
            a, b, n_near = a[:, near], b[:, near], np.bincount(row[near], minlength=batch.num_rows)
            taken, found, of = [], [], []
            first_at, first_edge = np.cumsum(n_at) - n_at, np.cumsum(n_near) - n_near
            for k in np.flatnonzero(n_near):
                i, n, j, m = first_at[k], n_at[k], first_edge[k], n_near[k]
                d = _segment_km(p[:, i:i + n], a[:, j:j + m], b[:, j:j + m])
                best = np.round(d, 9).argmin(axis=1)
                taken.append(near[j + best])
                found.append(d[np.arange(n), best])
                of.append(np.arange(i, i + n))
            if of:
                of = np.concatenate(of)
                rows = pa.array(np.repeat(np.arange(batch.num_rows), n_at)[of])
                yield pa.RecordBatch.from_arrays([*(column[g].take(rows) for g in group), pa.array(xs[of]), pa.array(ys[of]),
                                                  pa.array(np.concatenate(found)), ends.field("f").take(pa.array(np.concatenate(taken)))], names=names)

    return measure


def nearest_feature(points: DataFrame, edges: DataFrame, feature: str, group: list[str] | None = None,
                    x: str = "lon", y: str = "lat") -> DataFrame:
    """Nearest feature of each distinct position (of the same ``group``), and its distance.

    Runs of neighbouring positions descend a tree that is cut by counts: of the children of a node a run keeps those that
    cannot be farther than the nearest known feature for any of its positions, which are all within ``_far`` of its middle.
    A run meets ``_FAN`` boxes a node, wherever features are dense.  The root, one row of that many boxes, is broadcast
    where there are no groups.  The runs and the leaves that are left are dealt to tasks by their number, however few
    bytes they are and wherever they lie; a task measures a run against a leaf at once and gives one row per position.
    Ties go to the smaller feature key.  A point feature is an edge of length zero.
    """
    group = group or []
    leaves, levels = _packed_tree(edges, feature, group)
    spots = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *group, *[F.col(c).cast("double").alias(c) for c in (x, y)]).distinct()
    blocks = staged(_position_blocks(spots, group, x, y))
    key = [*group, "_block", "_mx", "_my", "_far"]
    rows = blocks.repartition(1 + blocks.count() // _RUNS_A_TASK).select(*key, F.lit(0).cast("bigint").alias("_node"), F.lit(float("inf")).alias("_best"))
    for i, nodes in enumerate(reversed(levels)):
        met = rows.join(F.broadcast(nodes), "_node") if i == 0 and not group else rows.join(nodes, [*group, "_node"])
        bounds = F.transform("_children", lambda c: F.struct(
            c["id"].alias("id"), (box_distance_floor_km("_mx", "_my", c["xa"], c["ya"], c["xb"], c["yb"]) - c["half"]).alias("least"),
            distance_km("_mx", "_my", c["rep"]["x1"], c["rep"]["y1"]).alias("most")))
        best = F.least("_best", F.array_min(F.transform("_bounds", lambda c: c["most"])))
        met = met.withColumn("_bounds", bounds).withColumn("_best", best)
        kept = F.filter("_bounds", lambda c: c["least"] <= F.col("_best") + 2 * F.col("_far") + 1e-6)
        rows = met.select(*key, "_best", F.explode(kept).alias("_c")).select(*key, F.col("_c.id").alias("_node"), "_best")
    left = staged(rows.select(*group, "_block", "_node", "_mx", "_my", (F.col("_best") + 2 * F.col("_far")).alias("_reach")))
    tasks = 1 + left.count() // _PAIRS_A_TASK
    met = left.join(blocks.select(*group, "_block", "_xs", "_ys"), [*group, "_block"]).join(
        leaves.select(*group, "_node", F.array_sort("_edges").alias("_edges")), [*group, "_node"])
    kind = {**{c.name: c.dataType for c in edges.schema}, **{c.name: c.dataType for c in points.schema}}
    double = T.DoubleType()
    out = T.StructType([*[T.StructField(g, kind[g]) for g in group], T.StructField(x, double), T.StructField(y, double),
                        T.StructField("_d", double), T.StructField("f", edges.schema[feature].dataType)])
    measured = met.select(*group, "_mx", "_my", "_reach", "_xs", "_ys", "_edges").repartition(tasks).mapInArrow(_measured(group, out.names), out)
    return measured.groupBy(*group, x, y).agg(F.min(F.struct(F.round("_d", 9).alias("d"), "f")).alias("_best")).select(
        *group, x, y, F.col("_best.f").alias(feature), F.col("_best.d").alias("dist_km"))


def nearest_polygon(points: DataFrame, edges: DataFrame, poly: str, group: list[str] | None = None,
                    x: str = "lon", y: str = "lat", cell: float = 1.0) -> DataFrame:
    """Nearest polygon of each distinct position; distance 0 inside, smallest key among several."""
    group = group or []
    own = edges.select(*group, poly).distinct()
    inside = covering_polygons(points, edges, poly, x, y, cell)
    asked = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, x, y).distinct()
    if group:
        inside = inside.join(own, poly)
    held = inside.join(asked, [*group, x, y]).groupBy(*group, x, y).agg(F.min(poly).alias(poly)).withColumn(
        "dist_km", F.lit(0.0))
    held = staged(held)
    outside = asked.join(held, [*group, x, y], "left_anti")
    return held.unionByName(nearest_feature(outside, edges, poly, group, x, y))


def polygon_distances(pairs: DataFrame, edges: DataFrame, a: str, b: str, poly: str) -> DataFrame:
    """Great-circle distance of each pair of polygons; 0 where they share a place."""
    pairs = pairs.select(a, b).distinct()
    e = lambda name, tag: edges.select(
        F.col(poly).alias(name), *[F.col(c).alias(f"{c}{tag}") for c in ("x1", "y1", "x2", "y2")])
    met = pairs.join(e(a, "a"), a).join(e(b, "b"), b)
    side_a, side_b = ("x1a", "y1a", "x2a", "y2a"), ("x1b", "y1b", "x2b", "y2b")
    near = F.least(segment_distance_km("x1a", "y1a", *side_b), segment_distance_km("x1b", "y1b", *side_a))
    cross = planar_edge_distance(side_a, side_b) == 0
    gap = met.groupBy(a, b).agg(F.min(F.when(cross, F.lit(0.0)).otherwise(near)).alias("_gap"))
    # a polygon inside the other: its first corner meets the other's edges, of the asked pairs only
    first = edges.groupBy(poly).agg(F.min(F.struct("x1", "y1")).alias("_v"))
    asked = union_all(*[pairs.select(a, b, F.col(i).alias("_in"), F.col(o).alias("_out")) for i, o in ((a, b), (b, a))])
    placed = asked.join(first.select(F.col(poly).alias("_in"), "_v"), "_in").select(a, b, "_in", "_out", F.col("_v.x1").alias("x"), F.col("_v.y1").alias("y"))
    crossed = placed.join(edges.withColumnRenamed(poly, "_out"), "_out").groupBy(a, b, "_in").agg(F.sum(crossing("x", "y", "x1", "y1", "x2", "y2")).alias("_n"))
    holds = crossed.where(F.col("_n") % 2 == 1).select(a, b).distinct().withColumn("_held", F.lit(1))
    return gap.join(holds, [a, b], "left").select(
        a, b, F.when(F.col("_held").isNotNull(), F.lit(0.0)).otherwise(F.col("_gap")).alias("dist_km"))


def near_polygon_pairs(edges: DataFrame, poly: str, within: float, cell: float, group: list[str] | None = None) -> DataFrame:
    """Pairs of polygons (smaller key first) of one group at most ``within`` apart and their ``gap``, projected units."""
    group = group or []
    side = ("x1", "y1", "x2", "y2")
    one, other = f"{poly}_a", f"{poly}_b"

    def filed(tag: str, grow: float) -> DataFrame:
        xs = F.sequence(_cell(F.least("x1", "x2") - grow, cell), _cell(F.greatest("x1", "x2") + grow, cell))
        ys = F.sequence(_cell(F.least("y1", "y2") - grow, cell), _cell(F.greatest("y1", "y2") + grow, cell))
        return edges.withColumn("_cx", F.explode(xs)).withColumn("_cy", F.explode(ys)).select(
            *group, "_cx", "_cy", F.col(poly).alias(f"{poly}{tag}"), *[F.col(c).alias(c + tag) for c in side])

    met = filed("_a", within).join(filed("_b", 0.0), [*group, "_cx", "_cy"]).where(F.col(one) < F.col(other))
    gap = planar_edge_distance(tuple(c + "_a" for c in side), tuple(c + "_b" for c in side))
    near = met.select(*group, one, other, gap.alias("gap")).where(F.col("gap") <= within + 1e-9)
    # a polygon inside another one is near it whatever its edges say
    first = edges.groupBy(*group, poly).agg(F.min(F.struct("x1", "y1")).alias("_v")).select(
        *group, F.col(poly).alias("_in"), F.col("_v.x1").alias("x"), F.col("_v.y1").alias("y"))
    held = covering_polygons(first, edges, poly, "x", "y", cell).join(first, ["x", "y"]).where(
        F.col("_in") != F.col(poly))
    if group:
        held = held.join(edges.select(*group, poly).distinct(), [*group, poly])
    held = held.select(*group, F.least("_in", poly).alias(one), F.greatest("_in", poly).alias(other), F.lit(0.0).alias("gap"))
    return near.unionByName(held).groupBy(*group, one, other).agg(F.min("gap").alias("gap"))


def polygon_measures(edges: DataFrame, poly: list[str]) -> DataFrame:
    """Area and centroid of each polygon in its own units; a polygon of area 0 has no centroid."""
    w = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    sums = edges.groupBy(*poly).agg(
        F.sum(w).alias("a2"), F.sum((F.col("x1") + F.col("x2")) * w).alias("sx"),
        F.sum((F.col("y1") + F.col("y2")) * w).alias("sy"))
    return sums.select(*poly, (F.abs("a2") / 2).alias("area"),
                       F.try_divide(F.col("sx"), 3 * F.col("a2")).alias("x"), F.try_divide(F.col("sy"), 3 * F.col("a2")).alias("y"))


def _contracted(links: DataFrame) -> DataFrame:
    """The links (u, v) of each task as stars around the smallest node that they connect; ``v`` is the smaller end."""
    kind = to_arrow_type(links.schema["u"].dataType)

    def stars(batches):
        parent: dict = {}

        def root(n):
            while parent[n] != n:
                parent[n] = parent[parent[n]]
                n = parent[n]
            return n

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                parent.setdefault(u, u)
                parent.setdefault(v, v)
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        ends = [(n, root(n)) for n in parent]
        ends = [(n, r) for n, r in ends if n != r]
        yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in ends], kind) for i in (0, 1)], names=["u", "v"])

    return links.mapInArrow(stars, links.schema)


def connected_components(nodes: DataFrame, pairs: DataFrame, node: str, a: str, b: str) -> DataFrame:
    """Smallest node key of the component of every node.

    Each task first contracts its own links to stars; pairs that lie together, as neighbours do, leave few links.  Then
    two rounds of hooking alternate: all larger neighbours of a node move to its smallest neighbour, then all smaller ones
    do.  Both are a minimum per node and a join, and each outcome is written, so lineage does not grow.  The pairs end as
    stars around the smallest key.
    """
    links = pairs.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    links = staged(_contracted(links.repartitionByRange("v")).distinct())
    state = None
    while True:  # every round that changes anything brings some node nearer to the smallest
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.count(F.lit(1)).alias(ROWS), F.least(F.min("v"), F.col("u")).alias("m"))
        larger = attach_per_key(both, low, ["u"], "inner").where(F.col("v") > F.col("u"))
        big = staged(larger.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = big.groupBy("u").agg(F.count(F.lit(1)).alias(ROWS), F.min("v").alias("m"))
        smaller = attach_per_key(big, low, ["u"], "inner")
        links = staged(union_all(
            smaller.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")),
            low.select("u", F.col("m").alias("v"))).distinct())
        now = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == (now["n"], now["s"]):
            break
        state = (now["n"], now["s"])
    return nodes.select(node).distinct().join(links.select(F.col("u").alias(node), "v"), node, "left").select(
        node, F.coalesce("v", node).alias("component"))


def water_systems(edges: DataFrame, poly: str, kind: str, gap: float, cell: float) -> DataFrame:
    """Water bodies of one kind that touch form a cluster, those within ``gap`` a system.

    Gives per water body its cluster, its system (both named by the smallest key), the number of
    bodies and the area of the system, and its own area.  Distances are found once; systems are
    components of the clusters.
    """
    one, other = f"{poly}_a", f"{poly}_b"
    bodies = staged(polygon_measures(edges, [poly, kind]).withColumnRenamed("area", "wb_area").select(poly, kind, "wb_area"))
    pairs = staged(near_polygon_pairs(edges, poly, gap, cell, [kind]).select(one, other, "gap"))
    touching = staged(connected_components(bodies, pairs.where(F.col("gap") <= 1e-9), poly, one, other).withColumnRenamed("component", "cluster"))
    of = lambda c, name: touching.select(F.col(poly).alias(c), F.col("cluster").alias(name))
    apart = pairs.where(F.col("gap") > 1e-9).join(of(one, "_c_a"), one).join(of(other, "_c_b"), other).where(
        F.col("_c_a") != F.col("_c_b")).select("_c_a", "_c_b").distinct()
    near = connected_components(touching, apart, "cluster", "_c_a", "_c_b").withColumnRenamed("component", "sys_id")
    rows = bodies.join(touching, poly).join(near, "cluster")
    systems = rows.groupBy("sys_id").agg(F.count(F.lit(1)).alias(ROWS), F.count(F.lit(1)).alias("sys_n"),
                                         F.sum("wb_area").alias("sys_area"))
    return attach_per_key(rows, systems, ["sys_id"], "inner").select(poly, kind, "wb_area", "cluster", "sys_id", "sys_n", "sys_area")
