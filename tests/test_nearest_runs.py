"""Nearest features by runs of positions, polygons that hold a position, distances of asked pairs (findings of round 3)."""

import math

import numpy as np
import pytest

from fieldtrace.operators import spatial


def _box(key, x, y, w, h, *more):
    corners = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    return [(key, *more, *a, *b) for a, b in zip(corners, corners[1:] + corners[:1])]


def _km(p, q):
    (a, b), (c, d) = ([math.radians(v) for v in z] for z in (p, q))
    h = math.sin((d - b) / 2) ** 2 + math.cos(b) * math.cos(d) * math.sin((c - a) / 2) ** 2
    return 2 * 6371.01 * math.asin(min(1.0, math.sqrt(h)))


def test_runs_descend_together(spark):
    rng = np.random.default_rng(5)
    spots = [(float(x), float(y)) for x, y in np.concatenate([rng.uniform((-10, 35), (18, 55), (700, 2)), rng.normal((2, 48), 0.01, (300, 2))])]
    df = spark.createDataFrame(spots, "lon double, lat double")
    runs = spatial._position_blocks(df.distinct(), [], "lon", "lat").collect()
    assert len(runs) == -(-1000 // spatial._TOGETHER)
    for r in runs:
        assert r._far == pytest.approx(max(_km((r._mx, r._my), p) for p in zip(r._xs, r._ys)))


@pytest.mark.parametrize("grouped", [False, True])
def test_runs_find_what_all_pairs_find(spark, grouped):
    rng = np.random.default_rng(6)
    spots = [(i % 2, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate(
        [rng.uniform((-10, 35), (18, 55), (300, 2)), rng.normal((2, 48), 0.01, (200, 2)), [[179.9, 10.0], [-179.9, 10.0]]]))]
    sites = [(f"s{i % 140:03d}", i % 2, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate(
        [rng.uniform((-10, 35), (18, 55), (140, 2)), rng.normal((2, 48), 0.01, (140, 2)), [[179.95, 10.0], [-179.8, 10.1]]]))]
    points = spark.createDataFrame(spots, "g int, lon double, lat double")
    edges = spark.createDataFrame([(f, g, x, y, x, y) for f, g, x, y in sites], "f string, g int, x1 double, y1 double, x2 double, y2 double")
    got = spatial.nearest_feature(points, edges, "f", ["g"] if grouped else None).collect()
    assert len(got) == len(spots)
    for r in got:
        own = [s for s in sites if not grouped or s[1] == r.g]
        d, f = min((round(_km((r.lon, r.lat), (x, y)), 9), f) for f, _, x, y in own)
        assert r.dist_km == pytest.approx(d, abs=2e-9) and r.f == f


def test_array_distances_are_those_of_the_expression(spark):
    from pyspark.sql import functions as F

    from fieldtrace.functions.geo import segment_distance_km
    rng = np.random.default_rng(7)
    p, e = rng.uniform((-10, 35), (18, 55), (20, 2)), rng.uniform((-10, 35, -10, 35), (18, 55, 18, 55), (30, 4))
    e[::3, 2:] = e[::3, :2]
    p[0] = e[0, :2]
    rows = [(i, j, *map(float, p[i]), *map(float, e[j])) for i in range(len(p)) for j in range(len(e))]
    df = spark.createDataFrame(rows, "i int, j int, lon double, lat double, x1 double, y1 double, x2 double, y2 double")
    got = spatial._segment_km(spatial._unit_vectors(*p.T), spatial._unit_vectors(*e.T[:2]), spatial._unit_vectors(*e.T[2:]))
    for r in df.select("i", "j", segment_distance_km("lon", "lat", "x1", "y1", "x2", "y2").alias("d"), F.lit(0)).collect():
        assert got[r.i, r.j] == pytest.approx(r.d, abs=1e-9)


def test_only_edges_beside_a_position_are_counted(spark):
    """A cell full of polygons gives a position no rows but those of polygons that hold it, and its join has many tasks."""
    boxes = [e for i in range(200) for e in _box(i, 0.004 * i, 0.1, 0.003, 0.2)]
    edges = spark.createDataFrame(boxes, "p int, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(0.004 * i + 0.001, 0.2) for i in range(200)] + [(0.0035, 0.2), (0.0011, 0.9)], "lon double, lat double")
    held = spatial.covering_polygons(points, edges, "p")
    assert sorted((round(r.lon, 4), r.p) for r in held.collect()) == [(round(0.004 * i + 0.001, 4), i) for i in range(200)]
    plan = held._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join Inner" in line and "_cx" in line)
    assert "_xa" in join and "y1" in join and "RepartitionByExpression" in plan


def test_distances_look_only_at_asked_pairs(spark, monkeypatch):
    boxes = _box(1, 0.0, 0.0, 1.0, 1.0) + _box(2, 0.4, 0.4, 0.1, 0.1) + _box(3, 3.0, 0.0, 1.0, 1.0) + _box(4, 0.45, 0.45, 0.01, 0.01)
    edges = spark.createDataFrame(boxes, "p int, x1 double, y1 double, x2 double, y2 double")
    monkeypatch.setattr(spatial, "covering_polygons", None)
    pairs = spark.createDataFrame([(1, 2), (2, 1), (4, 1), (1, 3)], "a int, b int")
    got = {(r.a, r.b): r.dist_km for r in spatial.polygon_distances(pairs, edges, "a", "b", "p").collect()}
    assert got.pop((1, 3)) == pytest.approx(_km((1, 0), (3, 0)), rel=1e-3) and got == {(1, 2): 0, (2, 1): 0, (4, 1): 0}
