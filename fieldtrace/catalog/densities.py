"""Histograms, kernel densities, draws and the tropism test."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.catalog import query
from fieldtrace.catalog.models import SITE_SQL, sites_and_water
from fieldtrace.functions.geo import REPORT_BOX, to_lambert
from fieldtrace.functions.time import season
from fieldtrace.operators import density, resample
from fieldtrace.operators.joins import natural_join
from fieldtrace.sources.store import staged

REPLICATES = 1_000  # of the checked queries, as the reference draws; the operators take any number


@query("D1", """
WITH e AS (SELECT MIN(dist_pt_km) AS lo, (MAX(dist_pt_km) - MIN(dist_pt_km)) / 9 AS w FROM {seasonal_orders} WHERE sp IS NOT NULL),
o AS (SELECT w, FLOOR(lo / w) * w AS origin FROM e),
h AS (SELECT sp, CAST(GREATEST(CEIL((dist_pt_km - origin) / w) - 1, 0) AS BIGINT) AS bin, SUM(wgt_co) AS weight, ANY_VALUE(w) AS w, ANY_VALUE(origin) AS o
  FROM {seasonal_orders}, o WHERE sp IS NOT NULL GROUP BY 1, 2)
SELECT sp, bin, ROUND(o + bin * w, 4) AS low, ROUND(weight, 6) AS weight, ROUND(weight / (SUM(weight) OVER (PARTITION BY sp) * w), 9) AS density FROM h""")
def weighted_histogram(t):
    h = density.histogram(t.seasonal_orders.where(F.col("sp").isNotNull()), ["sp"], "dist_pt_km", "wgt_co", bins=10)
    return h.select("sp", "bin", F.round("low", 4).alias("low"), F.round("weight", 6).alias("weight"), F.round("density", 9).alias("density"))


@query("D1 F16", """
SELECT status, bin, ROUND(SUM(wgt_co), 4) AS weight FROM (SELECT status, wgt_co,
  CAST(GREATEST(CEIL((LOG10(wb_area_ha) - o) / 0.125) - 1, 0) AS BIGINT) AS bin FROM {lineitem_price},
  (SELECT FLOOR(MIN(LOG10(wb_area_ha)) / 0.125) * 0.125 AS o FROM {lineitem_price}) z) x GROUP BY 1, 2""")
def log_histogram(t):
    h = density.histogram(t.lineitem_price, ["status"], "wb_area_ha", "wgt_co", binwidth=0.125, log10=True)
    return h.select("status", "bin", F.round("weight", 4).alias("weight"))


@query("D1", """
SELECT nes_reg, bin, ROUND(SUM(wgt_co), 4) AS weight FROM (SELECT nes_reg, wgt_co, CAST(GREATEST(CEIL((a - FLOOR((lo + 180) / 22.5) * 22.5 + 180) / 22.5) - 1, 0) AS BIGINT) AS bin
  FROM (SELECT nes_reg, wgt_co, ((id * 37) % 360) - 179.5e0 AS a, MIN(((id * 37) % 360) - 179.5e0) OVER () AS lo FROM {seasonal_orders}) y) x GROUP BY 1, 2""")
def direction_histogram(t):
    rows = t.seasonal_orders.withColumn("a", (F.col("id") * 37) % 360 - F.lit(179.5))
    h = density.histogram(rows, ["nes_reg"], "a", "wgt_co", binwidth=22.5, boundary=-180.0)
    return h.select("nes_reg", "bin", F.round("weight", 4).alias("weight"))


def density_sql(rows: str, n: int, nodes: int, params: str, tail: str) -> str:
    """SQL of the kernel density of ``rows(g, v, w)`` with ``params(g, bw, x0, x1)``; ``tail`` reads ``y(g, k, x, y)``."""
    return f"""
WITH rows AS ({rows}), params AS ({params}),
p AS (SELECT g, bw, x0, x1, (x1 - x0 + 8 * bw) / {nodes - 1} AS step, (x1 - x0) / {n - 1} AS os FROM params),
a AS (SELECT r.g, (v - (x0 - 4 * bw)) / step AS pos, w FROM rows r JOIN p ON r.g IS NOT DISTINCT FROM p.g),
b AS (SELECT g, i, SUM(m) AS m FROM (SELECT g, FLOOR(pos) AS i, w * (1 - (pos - FLOOR(pos))) AS m FROM a
  UNION ALL SELECT g, FLOOR(pos) + 1, w * (pos - FLOOR(pos)) FROM a) z WHERE i BETWEEN 0 AND {nodes - 1} GROUP BY 1, 2),
k AS (SELECT b.g, b.i, b.m, p.bw, p.step, r.k, p.x0 + r.k * p.os AS x, (r.k * p.os + 4 * p.bw) / p.step AS pos
  FROM b JOIN p ON b.g IS NOT DISTINCT FROM p.g, range(0, {n}) r(k)),
y AS (SELECT g, CAST(k AS INT) AS k, MIN(x) AS x, SUM(m * ((1 - (pos - FLOOR(pos))) * EXP(-0.5 * POW((FLOOR(pos) - i) * step / bw, 2))
  + (pos - FLOOR(pos)) * EXP(-0.5 * POW((FLOOR(pos) + 1 - i) * step / bw, 2))) / (bw * SQRT(2 * PI()))) AS y FROM k GROUP BY 1, 2)
{tail}"""


_THUMB = """SELECT g, 0.9e0 * {adjust} * LEAST(STDDEV_SAMP(v), (QUANTILE_CONT(v, 0.75) - QUANTILE_CONT(v, 0.25)) / 1.34) * POW(COUNT(*), -0.2) AS bw,
  MIN(v) AS lo, MAX(v) AS hi FROM rows GROUP BY g"""


@query("D2 A12", density_sql(
    "SELECT nes_reg AS g, dist_pt_km / 1000 AS v, wgt_co AS w FROM {seasonal_orders}", 512, 512,
    "SELECT g, bw, lo - 3 * bw AS x0, hi + 3 * bw AS x1 FROM (" + _THUMB.format(adjust=2) + ") t",
    "SELECT y.g AS nes_reg, k AS point, ROUND(x, 6) AS x, ROUND(y / s, 9) AS density FROM y JOIN (SELECT g, SUM(w) AS s FROM rows GROUP BY g) q ON q.g = y.g"))
def kernel_density(t):
    rows = t.seasonal_orders.withColumn("v", F.col("dist_pt_km") / 1000)
    d = density.kernel_density(rows, ["nes_reg"], "v", "wgt_co", adjust=2.0)
    return d.select("nes_reg", "point", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


@query("D3 J18", density_sql(
    """SELECT sp AS g, a + s AS v, wgt_co AS w FROM (SELECT sp, wgt_co, ((id * 37) % 360) * ((id * 37) % 360) / 360e0 - 179.5e0 AS a FROM {seasonal_orders}) z,
    (VALUES (-360), (0), (360)) q(s)""", 1000, 1024, "SELECT g, 12e0 AS bw, MIN(v) - 36 AS x0, MAX(v) + 36 AS x1 FROM rows GROUP BY g",
    """SELECT g AS sp, k AS point, ROUND(x, 6) AS angle_deg, ROUND(y / SUM(y) OVER (PARTITION BY g), 9) AS density FROM y WHERE x BETWEEN -180 AND 180"""))
def circular_density(t):
    u = (F.col("id") * 37) % 360
    rows = t.seasonal_orders.withColumn("a", u * u / F.lit(360.0) - F.lit(179.5))
    d = density.circular_density(rows, ["sp"], "a", "wgt_co")
    return d.select("sp", "point", F.round("angle_deg", 6).alias("angle_deg"), F.round("density", 9).alias("density"))


def grid_sql(points: str, box, n: int) -> str:
    """SQL of the relative density of ``points(g, x, y)`` on n x n cells over ``box``, counted four times finer first."""
    sx, sy = (f"({box[1][i]}e0 - {box[0][i]}e0) / {4 * (n - 1)}" for i in (0, 1))
    reach = lambda i, bw, step: f"BETWEEN FLOOR(({i} - 8.5e0 * {bw} / ({step})) / 4) AND CEIL(({i} + 8.5e0 * {bw} / ({step})) / 4)"
    return f"""
WITH g AS (SELECT * FROM ({points}) w WHERE x BETWEEN {box[0][0]} AND {box[1][0]} AND y BETWEEN {box[0][1]} AND {box[1][1]}),
p AS (SELECT g, 1.06e0 * LEAST(STDDEV_SAMP(x), (QUANTILE_CONT(x, .75) - QUANTILE_CONT(x, .25)) / 1.34) * POW(COUNT(*), -0.2) AS bx,
  1.06e0 * LEAST(STDDEV_SAMP(y), (QUANTILE_CONT(y, .75) - QUANTILE_CONT(y, .25)) / 1.34) * POW(COUNT(*), -0.2) AS bt FROM g GROUP BY g),
a AS (SELECT g, (x - {box[0][0]}e0) / ({sx}) AS ax, (y - {box[0][1]}e0) / ({sy}) AS ay FROM g),
b AS (SELECT g, ix, iy, SUM(m) AS m FROM (SELECT g, FLOOR(ax) + dx AS ix, FLOOR(ay) + dy AS iy,
    ABS(1 - dx - (ax - FLOOR(ax))) * ABS(1 - dy - (ay - FLOOR(ay))) AS m FROM a, (VALUES (0), (1)) u(dx), (VALUES (0), (1)) v(dy)) z GROUP BY 1, 2, 3),
c AS (SELECT b.g, iy, kx, SUM(m * EXP(-0.5 * POW((kx * 4 - ix) * ({sx}) / bx, 2)) / bx) AS m FROM b JOIN p ON b.g = p.g, range(0, {n}) r(kx)
  WHERE kx {reach('ix', 'bx', sx)} GROUP BY 1, 2, 3),
e AS (SELECT c.g, kx, ky, SUM(m * EXP(-0.5 * POW((ky * 4 - iy) * ({sy}) / bt, 2)) / bt) AS m FROM c JOIN p ON c.g = p.g, range(0, {n}) s(ky)
  WHERE ky {reach('iy', 'bt', sy)} GROUP BY 1, 2, 3),
f AS (SELECT g AS grp, CAST(kx AS INT) AS kx, CAST(ky AS INT) AS ky, m / MAX(m) OVER (PARTITION BY g) AS nd FROM e)
SELECT grp, kx, ky, ROUND(nd, 6) AS ndensity, CASE WHEN nd >= 1 THEN 1e0 WHEN nd >= .8 THEN .8e0 WHEN nd >= .5 THEN .5e0 WHEN nd >= .1 THEN .1e0 WHEN nd >= .01 THEN .01e0 END AS level FROM f"""


_FRANCE_BOX = ((-502924.178, 5415141.481), (1664384.432, 7640147.180))


@query("D4 G8 J16", grid_sql("""SELECT g, 700000 + r * SIN(t) AS x, 12655612.0498755 - r * COS(t) AS y FROM (
  SELECT g, 11754255.42609608e0 * EXP(-0.7256077650532670e0 * LN(TAN(PI() / 4 + RADIANS(lat) / 2)
    * POW((1 - e * SIN(RADIANS(lat))) / (1 + e * SIN(RADIANS(lat))), e / 2))) AS r, 0.7256077650532670e0 * RADIANS(lon - 3) AS t
  FROM (SELECT CAST(co % 3 AS INT) AS g, lon, lat, 0.0818191910428158e0 AS e FROM {geo_customers}) l) k""", _FRANCE_BOX, 100))
def density_2d_classes(t):
    x, y = to_lambert("lon", "lat")
    rows = t.geo_customers.select("id", (F.col("co") % 3).cast("int").alias("grp"), x.alias("x"), y.alias("y"))
    d = density.density_2d(rows, ["grp"], "x", "y", _FRANCE_BOX)
    return d.select("grp", "kx", "ky", F.round("ndensity", 6).alias("ndensity"), "level")


@query("D4 J16", grid_sql("SELECT CAST(co % 3 AS INT) AS g, lon AS x, lat AS y FROM {geo_customers}", REPORT_BOX, 20))
def density_2d_cells(t):
    rows = t.geo_customers.withColumn("grp", (F.col("co") % 3).cast("int"))
    d = density.density_2d(rows, ["grp"], "lon", "lat", REPORT_BOX, points=20)
    return d.select("grp", "kx", "ky", F.round("ndensity", 6).alias("ndensity"), "level")


def _birds(t):
    """Individuals of the nesting sites; their site follows from the customer's nation."""
    return t.geo_customers.select(F.col("id").alias("ring"), F.col("co").alias("site_id"))


def _draws(t, replicates=REPLICATES):
    return resample.site_draws(_birds(t), *sites_and_water(t), replicates)


_DRAWS = f"""WITH {SITE_SQL},
n AS (SELECT *, CAST(FLOOR((ROW_NUMBER() OVER (PARTITION BY site_id, cx, cy ORDER BY wb_id) - 1) / 512e0) AS BIGINT) AS part FROM (
  SELECT c.*, FLOOR(lon / 2) AS cx, FLOOR(lat / 2) AS cy FROM c JOIN {{geo_suppliers}} g ON g.wb_id = c.wb_id) k),
h AS (SELECT *, SUM(wgt) OVER (PARTITION BY site_id ORDER BY cx, cy, part, wb_id) AS hi FROM n WHERE wgt > 0),
v AS (SELECT *, COALESCE(LAG(hi) OVER (PARTITION BY site_id ORDER BY cx, cy, part, wb_id), 0) AS lo, MAX(hi) OVER (PARTITION BY site_id) AS total FROM h),
q AS (SELECT id AS ring, co AS site_id, CAST(r.k AS INT) AS replicate,
  CAST('0x' || SUBSTR(MD5(CAST(co AS VARCHAR) || '|' || CAST(id AS VARCHAR) || '|' || CAST(r.k AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496e0 AS x
  FROM {{geo_customers}}, range(1, {REPLICATES + 1}) r(k)),
drawn AS (SELECT q.ring, q.replicate, v.site_id, v.sp, v.wb_id, v.angle_deg FROM q JOIN v ON q.site_id = v.site_id
  AND q.x * v.total >= v.lo AND q.x * v.total < v.hi)"""


@query("D5 J18", _DRAWS + " SELECT ring, replicate, site_id, sp, wb_id FROM drawn")
def weighted_draws(t):
    return _draws(t).select("ring", "replicate", "site_id", "sp", "wb_id")


def _directions(t, replicates=REPLICATES):
    realized = t.geo_customers.join(t.sites.select(F.col("site_id").alias("co"), "sp"), "co").select(
        "sp", F.col("id").alias("ring"), ((F.col("id") * 37) % 360 - F.lit(179.5)).alias("angle_deg"),
        (1 + F.col("id") % 3).cast("double").alias("wgt_co"))
    return resample.with_realized(_draws(t, replicates), realized, "sp", "ring", "angle_deg", "wgt_co")


_SIM = _DRAWS + """, sim AS (SELECT s.sp, g.id AS ring, ((g.id * 37) % 360) - 179.5e0 AS angle_deg, 0 AS id, 'realized' AS migration, CAST(1 + g.id % 3 AS DOUBLE) AS wgt_co
  FROM {geo_customers} g JOIN {sites} s ON s.site_id = g.co UNION ALL SELECT sp, ring, angle_deg, replicate, 'potential', 1 FROM drawn)"""


@query("D5 U1 P18 P19", _SIM + " SELECT sp, ring, ROUND(angle_deg, 6) AS angle_deg, CAST(id AS INT) AS id, migration, wgt_co FROM sim")
def potential_and_realized(t):
    return _directions(t).select("sp", "ring", F.round("angle_deg", 6).alias("angle_deg"), "id", "migration", "wgt_co")


_SHARES = density_sql(
    "SELECT STRUCT_PACK(sp := sp, id := id, axis := axis) AS g, v, w FROM (" + _SIM + """ SELECT sp, id, 'East' AS axis, SIN(RADIANS(angle_deg)) AS v, wgt_co AS w FROM sim
      UNION ALL SELECT sp, id, 'North', COS(RADIANS(angle_deg)), wgt_co FROM sim) z""", 512, 512,
    "SELECT g, bw, -1e0 AS x0, 1e0 AS x1 FROM (" + _THUMB.format(adjust=1) + ") t",
    "SELECT g.sp AS sp, CAST(g.id AS INT) AS id, g.axis AS axis, SUM(CASE WHEN x > 0 THEN y ELSE 0 END) / SUM(y) AS prop FROM y GROUP BY g")


@query("D6 F20 F19", "SELECT sp, id, axis, ROUND(prop, 6) AS prop FROM (" + _SHARES + ") s")
def axis_density_shares(t):
    shares = resample.axis_shares(_directions(t), "sp", "angle_deg", "wgt_co", "ring")
    return shares.select("sp", "id", "axis", F.round("prop", 6).alias("prop"))


@query("M10 D7", """
SELECT sp, axis, COUNT(*) FILTER (id <> 0) AS n, COUNT(*) FILTER (id <> 0 AND NOT (prop > 0 AND prop < 1)) AS at_ends,
  ROUND(AVG(CASE WHEN id <> 0 AND prop > 0 THEN LN(prop) END), 6) AS log_p, ROUND(AVG(CASE WHEN id <> 0 AND prop < 1 THEN LN(1 - prop) END), 6) AS log_q,
  ROUND(AVG(prop) FILTER (id <> 0), 6) AS mean, ROUND(VAR_SAMP(prop) FILTER (id <> 0), 9) AS var,
  ROUND(QUANTILE_CONT(prop, 0.025) FILTER (id <> 0), 6) AS low, ROUND(QUANTILE_CONT(prop, 0.975) FILTER (id <> 0), 6) AS high,
  ROUND(MAX(prop) FILTER (id = 0), 6) AS realized FROM (""" + _SHARES + ") s GROUP BY sp, axis")
def beta_sufficient_statistics(t):
    stats = resample.beta_statistics(resample.axis_shares(_directions(t), "sp", "angle_deg", "wgt_co", "ring"), "sp")
    return stats.select("sp", "axis", "n", "at_ends", F.round("var", 9).alias("var"),
                        *[F.round(c, 6).alias(c) for c in ("log_p", "log_q", "mean", "low", "high", "realized")])


@query("D7 M10")
def tropism_test(t):
    return resample.tropism_test(resample.axis_shares(_directions(t), "sp", "angle_deg", "wgt_co", "ring"), "sp")


@query("D8", density_sql(
    "SELECT STRUCT_PACK(sp := sp, axis := axis) AS g, prop AS v, 1e0 AS w FROM (" + _SHARES + ") s WHERE id <> 0", 512, 512,
    "SELECT g, bw, lo - 3 * bw AS x0, hi + 3 * bw AS x1 FROM (" + _THUMB.format(adjust=2) + ") t",
    """SELECT y.g.sp AS sp, y.g.axis AS axis, k AS point, ROUND(x, 6) AS x, ROUND(y / n, 5) AS density, ROUND(r.prop, 6) AS realized
    FROM y JOIN (SELECT g, COUNT(*) AS n FROM rows GROUP BY g) q ON q.g = y.g
    LEFT JOIN (SELECT * FROM (""" + _SHARES + ") s WHERE id = 0) r ON r.sp IS NOT DISTINCT FROM y.g.sp AND r.axis = y.g.axis"))
def replicate_density(t):
    shares = staged(resample.axis_shares(_directions(t), "sp", "angle_deg", "wgt_co", "ring"))
    curve = density.kernel_density(shares.where(F.col("id") != 0), ["sp", "axis"], "prop", adjust=2.0)
    seen = shares.where(F.col("id") == 0).select("sp", "axis", F.col("prop").alias("realized"))
    both = natural_join(curve, seen, "left", on=["sp", "axis"])
    return both.select("sp", "axis", "point", F.round("x", 6).alias("x"), F.round("density", 5).alias("density"),
                       F.round("realized", 6).alias("realized"))


@query("O3 D1 F12", """
SELECT period, COUNT(*) AS n FROM (SELECT CASE WHEN d BETWEEN 106 AND 182 THEN 'repro' WHEN d BETWEEN 183 AND 244 THEN 'mue' WHEN d BETWEEN 245 AND 305 THEN 'post-mue'
  WHEN d BETWEEN 306 AND 320 THEN 'départ_hivernage' WHEN d >= 321 OR d <= 46 THEN 'hivernage' ELSE 'départ_repro' END AS period
  FROM (SELECT DAYOFYEAR(datetime) AS d FROM {seasonal_orders}) x) y GROUP BY period""")
def records_per_season(t):
    return t.seasonal_orders.groupBy(season("datetime").alias("period")).agg(F.count(F.lit(1)).alias("n"))
