"""Bearings, distances, polygons, nearest water and water systems."""

from __future__ import annotations


from pyspark.sql import functions as F

from fieldtrace.catalog import query
from fieldtrace.catalog.places import km
from fieldtrace.functions import geo
from fieldtrace.functions.codes import WATER_KINDS, labelled, map_country
from fieldtrace.functions.nullsafe import null_text, round_half_even
from fieldtrace.operators import spatial
from fieldtrace.plans import regions

_CELLS = "SELECT poly_id, name, MIN(x1) AS xa, MAX(x1) AS xb, MIN(y1) AS ya, MAX(y1) AS yb FROM {nation_cells} GROUP BY 1, 2"
LAKES = "SELECT wb_id, sys_id, MIN(x1) AS xa, MAX(x1) AS xb, MIN(y1) AS ya, MAX(y1) AS yb FROM {lake_edges} GROUP BY 1, 2"
_WATER = "SELECT wb_id, code, MIN(x1) AS xa, MAX(x1) AS xb, MIN(y1) AS ya, MAX(y1) AS yb FROM {water_edges} GROUP BY 1, 2"


def _vec(x: str, y: str) -> tuple[str, str, str]:
    return (f"(COS(RADIANS({y})) * COS(RADIANS({x})))", f"(COS(RADIANS({y})) * SIN(RADIANS({x})))", f"SIN(RADIANS({y}))")


def _cross(a, b):
    return (f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})")


def _dot(a, b):
    return f"({a[0]} * {b[0]} + {a[1]} * {b[1]} + {a[2]} * {b[2]})"


def segment_km(px: str, py: str, x1: str, y1: str, x2: str, y2: str) -> str:
    """SQL of the distance between a point and a great-circle segment."""
    p, a, b = _vec(px, py), _vec(x1, y1), _vec(x2, y2)
    n = _cross(a, b)
    return (f"CASE WHEN {_dot(_cross(n, a), p)} > 0 AND {_dot(_cross(b, n), p)} > 0 THEN 6371.01e0 * ASIN(LEAST(1.0, "
            f"ABS({_dot(n, p)}) / SQRT({_dot(n, n)}))) ELSE LEAST({km(px, py, x1, y1)}, {km(px, py, x2, y2)}) END")


@query("G1 G2 G3 F16", f"""
SELECT id, ROUND(DEGREES(ATAN2(COS(RADIANS(47.1)) * SIN(RADIANS(-1.66 - lon)), COS(RADIANS(lat)) * SIN(RADIANS(47.1))
  - SIN(RADIANS(lat)) * COS(RADIANS(47.1)) * COS(RADIANS(-1.66 - lon)))), 6) AS angle_deg,
  ROUND(DEGREES(ATAN2(-1.66 - lon, 47.1 - lat)), 6) AS angle_deg_base, ROUND({km('lon', 'lat', '-1.66e0', '47.1e0')}, 6) AS dist_pt_km,
  ROUND(LOG10(1 + {km('lon', 'lat', '-1.66e0', '47.1e0')}), 6) AS log_km FROM {{geo_customers}}""")
def bearings_and_distances(t):
    x, y = F.lit(-1.66), F.lit(47.1)
    d = geo.distance_km("lon", "lat", x, y)
    return t.geo_customers.select(
        "id", F.round(geo.bearing("lon", x, "lat", y), 6).alias("angle_deg"),
        F.round(geo.planar_bearing("lon", x, "lat", y), 6).alias("angle_deg_base"),
        F.round(d, 6).alias("dist_pt_km"), F.round(F.log10(1 + d), 6).alias("log_km"))


@query("F20 F21 M7", """
SELECT id, ROUND(SIN(RADIANS(a)), 6) AS East, ROUND(COS(RADIANS(a)), 6) AS North,
  ROUND(RADIANS(CASE WHEN a < 0 THEN 360 + a ELSE a END), 6) AS rad,
  ROUND(a, 6) AS back FROM (SELECT id, ((id * 37) % 360) - 179.5e0 AS a FROM {geo_customers}) x""")
def angle_columns(t):
    a = ((F.col("id") * 37) % 360) - F.lit(179.5)
    rows = t.geo_customers.select("id", a.alias("a"))
    rad = geo.full_turn_radians("a")
    return rows.select("id", F.round(geo.east_share("a"), 6).alias("East"), F.round(geo.north_share("a"), 6).alias("North"),
                       F.round(rad, 6).alias("rad"), F.round(geo.half_turn_degrees(rad), 6).alias("back"))


@query("G8 P22 G10", """
SELECT id, ROUND(700000 + r * SIN(g), 3) AS x, ROUND(12655612.0498755 - r * COS(g), 3) AS y FROM (
  SELECT id, 11754255.42609608e0 * EXP(-0.7256077650532670e0 * LN(TAN(PI() / 4 + RADIANS(lat) / 2)
    * POW((1 - e * SIN(RADIANS(lat))) / (1 + e * SIN(RADIANS(lat))), e / 2))) AS r, 0.7256077650532670e0 * RADIANS(lon - 3) AS g
  FROM (SELECT id, lon, lat, 0.0818191910428158e0 AS e FROM {geo_customers}) a) b""")
def lambert_projection(t):
    x, y = geo.to_lambert("lon", "lat")
    return t.geo_customers.select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("J11", f"""
SELECT p.id, c.poly_id FROM {{geo_customers}} p LEFT JOIN ({_CELLS}) c
ON p.lon >= c.xa AND p.lon < c.xb AND p.lat >= c.ya AND p.lat < c.yb""")
def points_in_polygons(t):
    return spatial.join_covering(t.geo_customers, t.nation_cells, "poly_id", cell=2.0).select("id", "poly_id")


@query("J12 G10", f"""
SELECT id, CASE WHEN {km('lon', 'lat', '-1.66e0', '47.1e0')} <= 70 THEN 'GRAND-LIEU' ELSE CAST(co AS VARCHAR) END AS co FROM {{geo_customers}}""")
def label_around_site(t):
    named = t.geo_customers.withColumn("co", F.col("co").cast("string"))
    return named.select("id", spatial.label_near_site("lon", "lat", "co", (-1.66, 47.1), 70.0, "GRAND-LIEU").alias("co"))


def _positions(t):
    return t.geo_suppliers.select("wb_id", *[F.col(c).alias(n) for c, n in
                                             (("lon", "x1"), ("lat", "y1"), ("lon", "x2"), ("lat", "y2"))])


@query("J13", f"""
SELECT id, wb_id, ROUND(ROUND(d, 9), 6) AS dist_km FROM (SELECT p.id, s.wb_id, d, ROW_NUMBER() OVER (PARTITION BY p.id ORDER BY ROUND(d, 9), s.wb_id) AS rn
  FROM {{geo_customers}} p, {{geo_suppliers}} s, LATERAL (SELECT {km('p.lon', 'p.lat', 's.lon', 's.lat')} AS d) z) x WHERE rn = 1""")
def nearest_site(t):
    near = spatial.nearest_feature(t.geo_customers, _positions(t), "wb_id")
    return t.geo_customers.join(near, ["lon", "lat"]).select("id", "wb_id", F.round("dist_km", 6).alias("dist_km"))


_NEAR_LAKE = f"""
SELECT id, co, wb_id, d FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY ROUND(d, 9), wb_id) AS rn FROM (
  SELECT p.id, p.co, e.wb_id, CASE WHEN BOOL_OR(p.lon >= l.xa AND p.lon < l.xb AND p.lat >= l.ya AND p.lat < l.yb) THEN 0.0
    ELSE MIN({segment_km('p.lon', 'p.lat', 'e.x1', 'e.y1', 'e.x2', 'e.y2')}) END AS d
  FROM {{geo_customers}} p, {{lake_edges}} e JOIN ({LAKES}) l ON l.wb_id = e.wb_id GROUP BY 1, 2, 3) x) y WHERE rn = 1"""


@query("J13 G4", f"SELECT id, wb_id, ROUND(ROUND(d, 9), 6) AS dist_alloc_km FROM ({_NEAR_LAKE}) z")
def nearest_water_body(t):
    near = spatial.nearest_polygon(t.geo_customers, t.lake_edges, "wb_id")
    return t.geo_customers.join(near, ["lon", "lat"]).select(
        "id", "wb_id", F.round("dist_km", 6).alias("dist_alloc_km"))


@query("G4 G6 P28 O2", f"""
SELECT id, co, ROUND_EVEN(ROUND(d, 9), 0) AS dist, CAST(id AS VARCHAR) || ' / ' || COALESCE(CAST(co AS VARCHAR), 'NA') AS spot_full FROM (
  SELECT p.id, p.co, MIN(CASE WHEN p.lon >= c.xa AND p.lon < c.xb AND p.lat >= c.ya AND p.lat < c.yb THEN 0
    ELSE {segment_km('p.lon', 'p.lat', 'e.x1', 'e.y1', 'e.x2', 'e.y2')} END) AS d
  FROM {{geo_customers}} p JOIN {{nation_cells}} e ON e.poly_id = p.co JOIN ({_CELLS}) c ON c.poly_id = e.poly_id GROUP BY 1, 2) x
WHERE ROUND_EVEN(ROUND(d, 9), 0) > 0 ORDER BY co, dist DESC, id""")
def outside_declared_country(t):
    edges = t.nation_cells.withColumn("co", F.col("poly_id"))
    near = spatial.nearest_polygon(t.geo_customers, edges, "poly_id", ["co"], cell=2.0)
    dist = round_half_even("dist_km").alias("dist")
    rows = t.geo_customers.join(near, ["co", "lon", "lat"]).select("id", "co", dist).where(F.col("dist") > 0)
    label = F.concat(null_text("id"), F.lit(" / "), null_text("co"))
    return rows.withColumn("spot_full", label).orderBy(F.col("co").asc_nulls_last(), F.col("dist").desc_nulls_last(), "id")


def box_gap_sql(a: str, b: str) -> str:
    ends = [segment_km(f"{a}.x1", f"{a}.y1", f"{b}.x1", f"{b}.y1", f"{b}.x2", f"{b}.y2"),
            segment_km(f"{b}.x1", f"{b}.y1", f"{a}.x1", f"{a}.y1", f"{a}.x2", f"{a}.y2")]
    return f"LEAST({ends[0]}, {ends[1]})"


@query("G5", f"""
WITH l AS ({LAKES}), p AS (SELECT a.wb_id AS wb, b.wb_id AS nes, (a.xa <= b.xb AND b.xa <= a.xb AND a.ya <= b.yb AND b.ya <= a.yb) AS meets
  FROM l a JOIN l b ON b.wb_id = (a.wb_id * 7 + 3) % (SELECT COUNT(DISTINCT wb_id) FROM {{lake_edges}}) AND a.wb_id <> b.wb_id)
SELECT wb, nes, ROUND(CASE WHEN BOOL_OR(meets) THEN 0 ELSE MIN({box_gap_sql('ea', 'eb')}) END, 6) AS dist_wb_km
FROM p JOIN {{lake_edges}} ea ON ea.wb_id = wb JOIN {{lake_edges}} eb ON eb.wb_id = nes GROUP BY 1, 2""")
def water_body_distances(t):
    ids = t.lake_edges.select("wb_id").distinct()
    n = ids.agg(F.count(F.lit(1)).alias("n")).scalar()
    pairs = ids.select(F.col("wb_id").alias("wb"), ((F.col("wb_id") * 7 + 3) % n).alias("nes")).where("wb <> nes")
    d = spatial.polygon_distances(pairs, t.lake_edges, "wb", "nes", "wb_id")
    return d.select("wb", "nes", F.round("dist_km", 6).alias("dist_wb_km"))


_GAP = "GREATEST(GREATEST(b.xa - a.xb, a.xa - b.xb, 0) * GREATEST(b.xa - a.xb, a.xa - b.xb, 0) + GREATEST(b.ya - a.yb, a.ya - b.yb, 0) * GREATEST(b.ya - a.yb, a.ya - b.yb, 0), 0)"
_KINDS = ("CASE WHEN code IN (411, 512) THEN 'soft_wb' WHEN code = 412 THEN 'peat' WHEN code IN (423, 522) THEN 'coast' "
          "WHEN code IN (421, 422, 521) THEN 'salt_wb' WHEN code = 511 THEN 'river' WHEN code = 523 THEN 'sea' END")


def _kinds(t):
    return t.water_edges.withColumn("sys_type", labelled("code", WATER_KINDS))


@query("J14", f"""
WITH w AS (SELECT *, {_KINDS} AS sys_type FROM ({_WATER}) x)
SELECT a.sys_type, a.wb_id AS wb_id_a, b.wb_id AS wb_id_b, ROUND(SQRT({_GAP}), 6) AS gap FROM w a JOIN w b ON a.sys_type = b.sys_type AND a.wb_id < b.wb_id
AND SQRT({_GAP}) <= 2000""")
def near_water_bodies(t):
    near = spatial.near_polygon_pairs(_kinds(t), "wb_id", 2000.0, 4000.0, ["sys_type"])
    return near.withColumn("gap", F.round("gap", 6))


@query("A14 A15 P16", f"""
SELECT wb_id, {_KINDS} AS sys_type, ROUND((xb - xa) * (yb - ya) * 1e-4, 6) AS wb_area_ha, ROUND((xa + xb) / 2, 3) AS x, ROUND((ya + yb) / 2, 3) AS y
FROM ({_WATER}) w""")
def areas_and_centroids(t):
    m = spatial.polygon_measures(_kinds(t), ["wb_id", "sys_type"])
    return m.select("wb_id", "sys_type", F.round(F.col("area") * 1e-4, 6).alias("wb_area_ha"),
                    F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def _components(gap: int) -> str:
    return f"""(WITH RECURSIVE e AS (SELECT a.wb_id AS u, b.wb_id AS v FROM w a JOIN w b ON a.sys_type = b.sys_type AND SQRT({_GAP}) <= {gap}),
  r AS (SELECT wb_id AS node, wb_id AS seen FROM w UNION SELECT r.node, e.v FROM r JOIN e ON r.seen = e.u)
  SELECT node, MIN(seen) AS lab FROM r GROUP BY node)"""


@query("G9 J14 W9", f"""
WITH w AS (SELECT *, {_KINDS} AS sys_type FROM ({_WATER}) x),
s AS (SELECT w.wb_id, w.sys_type, c.lab AS cluster, g.lab AS sys_id, (xb - xa) * (yb - ya) * 1e-4 AS ha FROM w
  JOIN {_components(0)} c ON c.node = w.wb_id JOIN {_components(2000)} g ON g.node = w.wb_id)
SELECT wb_id, sys_type, cluster, sys_id, ROUND(ha, 6) AS wb_area_ha, COUNT(*) OVER (PARTITION BY sys_id) AS sys_n,
  ROUND(SUM(ha) OVER (PARTITION BY sys_id), 6) AS sys_area_ha FROM s""")
def water_system_clusters(t):
    s = spatial.water_systems(_kinds(t), "wb_id", "sys_type", 2000.0, 4000.0)
    return s.select("wb_id", "sys_type", "cluster", "sys_id", F.round(F.col("wb_area") * 1e-4, 6).alias("wb_area_ha"),
                    "sys_n", F.round(F.col("sys_area") * 1e-4, 6).alias("sys_area_ha"))


@query("G11 J11 P18 F6", f"""
WITH c AS (SELECT wb_id, (xa + xb) / 2 AS lon, (ya + yb) / 2 AS lat FROM ({LAKES}) l),
w AS (SELECT co AS poly_id, COUNT(*) / 50e0 AS pres FROM {{geo_customers}} WHERE co < 12 GROUP BY co)
SELECT c.wb_id, CASE WHEN {km('c.lon', 'c.lat', '-1.66e0', '47.1e0')} <= 200 THEN 'GRAND-LIEU' ELSE UPPER(n.name) END AS win_co,
  ROUND(COALESCE(CASE WHEN {km('c.lon', 'c.lat', '-1.66e0', '47.1e0')} <= 200 THEN NULL ELSE w.pres END, 1), 6) AS wgt_pres
FROM c LEFT JOIN ({_CELLS}) n ON c.lon >= n.xa AND c.lon < n.xb AND c.lat >= n.ya AND c.lat < n.yb LEFT JOIN w ON w.poly_id = n.poly_id""")
def region_weights(t):
    mid = lambda a: (F.min(a) + F.max(a)) / 2
    centres = t.lake_edges.groupBy("wb_id").agg(mid("x1").alias("lon"), mid("y1").alias("lat"))
    held = spatial.join_covering(centres, t.nation_cells, "poly_id", cell=2.0, uid="wb_id")
    names = t.nation_cells.select("poly_id", map_country("name").alias("name")).distinct()
    pres = t.geo_customers.where(F.col("co") < 12).groupBy(F.col("co").alias("poly_id")).agg(
        (F.count(F.lit(1)) / 50).alias("pres"))
    rows = held.join(names, "poly_id", "left").join(pres, "poly_id", "left")
    site = lambda label: spatial.label_near_site("lon", "lat", label, (-1.66, 47.1), 200.0, "GRAND-LIEU")
    named = rows.withColumn("win_co", site("name"))
    own = F.when(F.col("win_co").eqNullSafe(F.lit("GRAND-LIEU")), None).otherwise(F.col("pres"))
    return named.select("wb_id", "win_co", F.round(F.coalesce(own, F.lit(1.0)), 6).alias("wgt_pres"))


_SITE_BOX = (-4.0, 0.0, 45.0, 49.0)


@query("G11 J11 P24 U1", f"""
WITH names AS (SELECT n_nationkey AS poly_id, UPPER(n_name) AS region FROM {{nation}} JOIN {{region}} ON r_regionkey = n_regionkey WHERE r_name = 'EUROPE'),
w AS (SELECT UPPER(n_name) AS region, COUNT(*) / 50e0 AS pres FROM {{geo_customers}} JOIN {{nation}} ON n_nationkey = co WHERE n_nationkey % 2 = 1 GROUP BY 1 UNION ALL SELECT 'GRAND-LIEU', 2.5e0),
h AS (SELECT g.id, CASE WHEN lon >= -4 AND lon < 0 AND lat >= 45 AND lat < 49 THEN 'GRAND-LIEU' ELSE n.region END AS region
  FROM {{geo_customers}} g LEFT JOIN ({_CELLS}) c ON g.lon >= c.xa AND g.lon < c.xb AND g.lat >= c.ya AND g.lat < c.yb LEFT JOIN names n ON n.poly_id = c.poly_id)
SELECT h.id, w.region, ROUND(COALESCE(w.pres, 1), 6) AS pres_co FROM h LEFT JOIN w ON w.region = h.region""")
def region_layer_weights(t):
    """Customers by region: a site inside some countries comes first, other continents have no region."""
    xa, xb, ya, yb = _SITE_BOX
    corners = [(xa, ya), (xb, ya), (xb, yb), (xa, yb)]
    site = t.spark.createDataFrame([(*a, *b) for a, b in zip(corners, corners[1:] + corners[:1])], "x1 double, y1 double, x2 double, y2 double")
    of = t.nation.join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_nationkey").alias("poly_id"), F.col("r_name").alias("continent"))
    countries = t.nation_cells.join(of, "poly_id")
    pres = t.geo_customers.join(t.nation.where(F.col("n_nationkey") % 2 == 1), F.col("n_nationkey") == F.col("co")).groupBy(
        map_country("n_name").alias("region")).agg((F.count(F.lit(1)) / 50).alias("pres_co"))
    weights = pres.unionByName(t.spark.createDataFrame([("GRAND-LIEU", 2.5)], "region string, pres_co double"))
    layer = regions.region_layer(countries, site, "EUROPE", "GRAND-LIEU")
    named = regions.label_regions(t.geo_customers, layer, weights, "pres_co", cell=2.0)
    return named.select("id", "region", F.round("pres_co", 6).alias("pres_co"))
