"""Fuzzy names, the resolution cascade and coordinate choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.catalog import query
from fieldtrace.functions.jaro import jaro_distance
from fieldtrace.operators.joins import natural_join
from fieldtrace.operators.resolve import best_match, fuzzy_join, reconcile_coordinates, resolve_places

_KM = ("12742.02e0 * ASIN(LEAST(1.0, SQRT(POW(SIN(RADIANS({d} - {b}) / 2), 2)"
       " + COS(RADIANS({b})) * COS(RADIANS({d})) * POW(SIN(RADIANS({c} - {a}) / 2), 2))))")


def km(a: str, b: str, c: str, d: str) -> str:
    """SQL of the great-circle distance between (a, b) and (c, d)."""
    return _KM.format(a=a, b=b, c=c, d=d)


@query("J8", """
SELECT l.com, l.spot, r.com AS com_2, r.spot AS spot_2, ROUND(1 - JARO_SIMILARITY(l.com, r.com), 6) AS com_d,
  ROUND(1 - JARO_SIMILARITY(l.spot, r.spot), 6) AS spot_d
FROM (SELECT DISTINCT com, spot FROM {part_names} WHERE spot IS NOT NULL) l JOIN {clean_names} r
ON 1 - JARO_SIMILARITY(l.com, r.com) <= 0.1 + 1e-9 AND 1 - JARO_SIMILARITY(l.spot, r.spot) <= 0.1 + 1e-9""")
def fuzzy_name_pairs(t):
    near = fuzzy_join(t.part_names, t.clean_names, ["com", "spot"])
    return near.select("com", "spot", "com_2", "spot_2", F.round("com_d", 6).alias("com_d"), F.round("spot_d", 6).alias("spot_d"))


@query("J8 J9 W2 O4", """
WITH l AS (SELECT DISTINCT com, spot FROM {part_names} WHERE spot IS NOT NULL),
hits AS (SELECT l.com, l.spot, r.id_spo, ROUND(2 - JARO_SIMILARITY(l.com, r.com) - JARO_SIMILARITY(l.spot, r.spot), 9) AS d
  FROM l JOIN {gazetteer} r ON 1 - JARO_SIMILARITY(l.com, r.com) <= 0.1 + 1e-9 AND 1 - JARO_SIMILARITY(l.spot, r.spot) <= 0.1 + 1e-9),
best AS (SELECT com, spot, id_spo, d FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY com, spot ORDER BY d, id_spo) AS rn FROM hits) x WHERE rn = 1)
SELECT p.id, b.id_spo, ROUND(b.d, 6) AS d FROM {part_names} p JOIN best b ON p.com = b.com AND p.spot = b.spot""")
def best_fuzzy_candidate(t):
    best = best_match(t.part_names, t.gazetteer, ["com", "spot"], "id_spo")
    return natural_join(t.part_names, best, "inner", expect=["com", "spot"]).select(
        "id", "id_spo", F.round("d", 6).alias("d"))


@query("J8", """
SELECT id, ROUND(1 - JARO_SIMILARITY(a, b), 6) AS d FROM (SELECT p_partkey AS id, p_name || ' ' || p_type AS a,
  p_type || REVERSE(p_name) AS b FROM part) x""")
def jaro_distance_of_texts(t):
    p = t.part
    a, b = F.concat("p_name", F.lit(" "), "p_type"), F.concat("p_type", F.reverse("p_name"))
    return p.select(F.col("p_partkey").alias("id"), F.round(jaro_distance(a, b), 6).alias("d"))


_NEAR = "1 - JARO_SIMILARITY(k.{0}, r.{0}) <= 0.1 + 1e-9"
CASCADE = f"""
WITH k AS (SELECT DISTINCT co, dpt, com, spot FROM {{places}}),
spot1 AS (SELECT k.*, r.lon_2, r.lat_2 FROM k JOIN {{spots}} r ON k.co = r.co AND k.com = r.com AND k.spot = r.spot),
k1 AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM spot1 s WHERE s.co IS NOT DISTINCT FROM k.co AND s.dpt IS NOT DISTINCT FROM k.dpt
  AND s.com IS NOT DISTINCT FROM k.com AND s.spot IS NOT DISTINCT FROM k.spot)),
spot2 AS (SELECT * FROM (SELECT k.*, r.co AS co_2, r.com AS com_2, r.spot AS spot_2, r.lon_2, r.lat_2, ROW_NUMBER() OVER (
    PARTITION BY k.co, k.dpt, k.com, k.spot ORDER BY ROUND(3 - JARO_SIMILARITY(k.co, r.co) - JARO_SIMILARITY(k.com, r.com)
      - JARO_SIMILARITY(k.spot, r.spot), 9), r.id_spo) AS rn
  FROM k1 k JOIN {{spots}} r ON {_NEAR.format('co')} AND {_NEAR.format('com')} AND {_NEAR.format('spot')}) x WHERE rn = 1),
k2 AS (SELECT * FROM k1 k WHERE NOT EXISTS (SELECT 1 FROM spot2 s WHERE s.co IS NOT DISTINCT FROM k.co AND s.dpt IS NOT DISTINCT FROM k.dpt
  AND s.com IS NOT DISTINCT FROM k.com AND s.spot IS NOT DISTINCT FROM k.spot)),
com1 AS (SELECT k.*, r.lon_2, r.lat_2 FROM k2 k JOIN {{communes}} r ON r.co = 'FRANCE' AND k.co = r.co AND k.com = r.com AND k.dpt = r.dpt
  UNION ALL SELECT k.*, r.lon_2, r.lat_2 FROM k2 k JOIN {{communes}} r ON r.co <> 'FRANCE' AND k.co = r.co AND k.com = r.com),
k3 AS (SELECT * FROM k2 k WHERE NOT EXISTS (SELECT 1 FROM com1 s WHERE s.co IS NOT DISTINCT FROM k.co AND s.dpt IS NOT DISTINCT FROM k.dpt
  AND s.com IS NOT DISTINCT FROM k.com AND s.spot IS NOT DISTINCT FROM k.spot)),
com3 AS (SELECT * FROM (SELECT k.*, r.co AS co_2, r.com AS com_2, r.lon_2, r.lat_2, ROW_NUMBER() OVER (
    PARTITION BY k.co, k.dpt, k.com, k.spot ORDER BY ROUND(2 - JARO_SIMILARITY(k.co, r.co) - JARO_SIMILARITY(k.com, r.com), 9), r.id_co) AS rn
  FROM k3 k JOIN {{communes}} r ON {_NEAR.format('co')} AND {_NEAR.format('com')} AND (r.co <> 'FRANCE' OR {_NEAR.format('dpt')})) x WHERE rn = 1),
hits AS (SELECT co, dpt, com, spot, CAST(NULL AS VARCHAR) AS co_2, CAST(NULL AS VARCHAR) AS com_2, CAST(NULL AS VARCHAR) AS spot_2, lon_2, lat_2, 'spot' AS match FROM spot1
  UNION ALL SELECT co, dpt, com, spot, co_2, com_2, spot_2, lon_2, lat_2, 'spot' FROM spot2
  UNION ALL SELECT co, dpt, com, spot, NULL, NULL, NULL, lon_2, lat_2, 'com' FROM com1
  UNION ALL SELECT co, dpt, com, spot, co_2, com_2, NULL, lon_2, lat_2, 'com' FROM com3),
joined AS (SELECT p.*, h.co_2, h.com_2, h.spot_2, h.lon_2, h.lat_2, h.match FROM {{places}} p LEFT JOIN hits h ON h.co IS NOT DISTINCT FROM p.co
  AND h.dpt IS NOT DISTINCT FROM p.dpt AND h.com IS NOT DISTINCT FROM p.com AND h.spot IS NOT DISTINCT FROM p.spot),
resolved AS (SELECT id, co, dpt, com, spot, lon, lat, co_2, com_2, spot_2,
  CASE WHEN searched THEN 4.5272e0 ELSE lon_2 END AS lon_2, CASE WHEN searched THEN 52.34632e0 ELSE lat_2 END AS lat_2,
  CASE WHEN searched THEN 'search' ELSE COALESCE(match, '-') END AS match
  FROM (SELECT *, (match IS NULL AND lon IS NULL AND co = 'FRANCE' AND com = 'Elsewhere' AND spot IS NULL) AS searched FROM joined) x)"""


def _resolved(t):
    found = t.spark.createDataFrame([("FRANCE", "Elsewhere", None, 4.5272, 52.34632)],
                                    "co string, com string, spot string, lon double, lat double")
    return resolve_places(t.places, t.spots, t.communes, found)


@query("J10 S6 U1 U2 W9", CASCADE + """
SELECT id, co_2, com_2, spot_2, ROUND(lon_2, 6) AS lon_2, ROUND(lat_2, 6) AS lat_2, match FROM resolved""")
def entity_resolution(t):
    return _resolved(t).select("id", "co_2", "com_2", "spot_2", F.round("lon_2", 6).alias("lon_2"),
                               F.round("lat_2", 6).alias("lat_2"), "match")


@query("G7 P15 G3", CASCADE + f"""
SELECT id, ROUND(dist, 6) AS dist, ROUND(CASE WHEN lon IS NULL OR COALESCE(dist > 15, FALSE) THEN lon_2 ELSE lon END, 6) AS lon,
  ROUND(CASE WHEN lat IS NULL OR COALESCE(dist > 15, FALSE) THEN lat_2 ELSE lat END, 6) AS lat,
  CASE WHEN com_2 IS NOT NULL THEN co_2 ELSE co END AS co, COALESCE(spot_2, spot) AS com
FROM (SELECT *, {km('lon', 'lat', 'lon_2', 'lat_2')} AS dist FROM resolved) x""")
def coordinate_choice(t):
    return reconcile_coordinates(_resolved(t)).select(
        "id", F.round("dist", 6).alias("dist"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "co", "com")


@query("P14 A2", CASCADE + f"""
SELECT match, COUNT(*) AS n, COUNT(*) FILTER (dist > 15) AS moved
FROM (SELECT *, {km('lon', 'lat', 'lon_2', 'lat_2')} AS dist FROM resolved) x GROUP BY match""")
def match_quality(t):
    return reconcile_coordinates(_resolved(t)).groupBy("match").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("dist") > 15).alias("moved"))
