"""Deterministic observation-like views over the test tables (definitions in FIXTURES.md).

The text of a view is shared by both engines of the result check; ``{name}`` stands for a base
table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
)


def box_edges(names: str, boxes: str) -> str:
    """Edge rows, counter-clockwise, of boxes given by their corners xa, xb, ya, yb."""
    sides = ("xa, ya, xb, ya", "xb, ya, xb, yb", "xb, yb, xa, yb", "xa, yb, xa, ya")
    return " UNION ALL ".join(
        "SELECT {n}, {i} AS seq, {a} AS x1, {b} AS y1, {c} AS x2, {d} AS y2 FROM ({t}) b".format(
            n=names, i=i, t=boxes, **dict(zip("abcd", side.split(", "))))
        for i, side in enumerate(sides, 1))


VIEWS = {
    "timeline": """
SELECT event_id AS id, user_id AS ring, ts AS datetime,
  CASE event_type WHEN 'signup' THEN 'BAGUAGE' WHEN 'purchase' THEN 'REPRISE' ELSE 'CONTROLE' END AS obs,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN user_id % 2 = 0 THEN 'AYTFER' ELSE 'AYTFUL' END AS sp,
  value AS wgh
FROM {events}""",
    "pairs": """
SELECT event_id AS id, user_id AS ring, CAST(ts AS DATE) AS day,
  CASE event_type WHEN 'signup' THEN 'BAGUAGE' WHEN 'purchase' THEN 'REPRISE' ELSE 'CONTROLE' END AS obs,
  CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'NON MARQUE'
    WHEN event_id % 10 = 1 AND event_type <> 'signup' THEN CONCAT('M', CAST(user_id + 1 AS STRING))
    ELSE CONCAT('M', CAST(user_id AS STRING)) END AS mark
FROM {events}""",
    "raw_obs": """
SELECT event_id AS id,
  CASE WHEN event_id % 23 = 0 THEN 'NA' WHEN event_id % 29 = 0 THEN '' ELSE CONCAT('R', CAST(user_id AS STRING)) END AS bague,
  CASE event_id % 7 WHEN 0 THEN 'F' WHEN 1 THEN 'Femelle' WHEN 2 THEN 'M' WHEN 3 THEN NULL ELSE '?' END AS sexe,
  CASE event_id % 9 WHEN 0 THEN '+1?' WHEN 1 THEN '+1A' WHEN 2 THEN '+2A' WHEN 3 THEN '1A' WHEN 4 THEN 'VOL' WHEN 5 THEN '2A' WHEN 6 THEN 'PUL' WHEN 7 THEN NULL ELSE 'X1' END AS age,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS action,
  ts
FROM {events}""",
    "seasonal_orders": """
SELECT o_orderkey AS id, o_custkey AS ring, o_orderdate AS datetime,
  CASE WHEN o_custkey % 9 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'AYTFER' ELSE 'AYTFUL' END AS sp,
  CASE o_custkey % 3 WHEN 0 THEN 'Ouest' WHEN 1 THEN 'Centre' ELSE 'Est' END AS nes_reg,
  o_totalprice AS dist_pt_km,
  CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS mig,
  CAST(1 + o_orderkey % 3 AS DOUBLE) AS wgt_co
FROM {orders}""",
    "dms_points": """
SELECT c_custkey AS id,
  CONCAT(CASE WHEN c_custkey % 2 = 0 THEN '-' ELSE '' END, CAST(c_custkey % 100 AS STRING)) AS long_deg,
  CASE WHEN c_custkey % 17 = 0 THEN '4a' ELSE CAST((c_custkey * 7) % 64 AS STRING) END AS long_min,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CONCAT(CAST((c_custkey * 11) % 60 AS STRING), ',', CAST(c_custkey % 10 AS STRING)) END AS long_sec,
  CAST(35 + c_custkey % 20 AS STRING) AS lat_deg,
  CAST((c_custkey * 3) % 60 AS STRING) AS lat_min,
  CONCAT(CAST((c_custkey * 5) % 60 AS STRING), ';', CAST(c_custkey % 7 AS STRING)) AS lat_sec
FROM {customer}""",
    "geo_customers": """
SELECT c_custkey AS id, c_nationkey AS co,
  -10 + CAST((c_custkey * 7919) % 28000 AS DOUBLE) / 1000 AS lon,
  35 + CAST((c_custkey * 6007) % 20000 AS DOUBLE) / 1000 AS lat
FROM {customer}""",
    "geo_suppliers": """
SELECT s_suppkey AS wb_id, s_nationkey AS sys_id,
  -10 + CAST((s_suppkey * 4211) % 28000 AS DOUBLE) / 1000 AS lon,
  35 + CAST((s_suppkey * 3571) % 20000 AS DOUBLE) / 1000 AS lat,
  CASE WHEN s_acctbal > 1 THEN s_acctbal ELSE 1.0 END AS wb_area_ha
FROM {supplier}""",
    "nation_cells": box_edges("poly_id, name", """
    SELECT n_nationkey AS poly_id, n_name AS name,
      -10 + 5.6e0 * (n_nationkey % 5) AS xa, -10 + 5.6e0 * (n_nationkey % 5 + 1) AS xb,
      35 + 4e0 * FLOOR(n_nationkey / 5e0) AS ya, 35 + 4e0 * FLOOR(n_nationkey / 5e0) + 3e0 AS yb
    FROM {nation}"""),
    "part_names": """
SELECT p_partkey AS id, p_brand AS com,
  CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN CONCAT(p_name, 's') WHEN 2 THEN REPLACE(p_name, ' ', '')
    WHEN 3 THEN REPLACE(p_name, 'g', 'q') ELSE NULL END AS spot
FROM {part}""",
    "clean_names": "SELECT DISTINCT p_brand AS com, p_name AS spot FROM {part}",
    "resolution": """
SELECT c.c_custkey AS id, p.p_brand AS com,
  CASE c.c_custkey % 4 WHEN 0 THEN p.p_name WHEN 1 THEN CONCAT(p.p_name, 's') WHEN 2 THEN REVERSE(p.p_name) ELSE NULL END AS spot,
  CASE WHEN c.c_custkey % 3 = 0 THEN NULL ELSE -10 + CAST((c.c_custkey * 7919) % 28000 AS DOUBLE) / 1000 END AS lon,
  CASE WHEN c.c_custkey % 3 = 0 THEN NULL ELSE 35 + CAST((c.c_custkey * 6007) % 20000 AS DOUBLE) / 1000 END AS lat
FROM {customer} c JOIN {part} p ON p.p_partkey = c.c_custkey""",
    "places": """
SELECT id, CASE id % 2 WHEN 0 THEN 'FRANCE' ELSE 'SPAIN' END AS co, CASE id % 3 WHEN 0 THEN NULL ELSE '44' END AS dpt,
  CASE id % 7 WHEN 3 THEN CONCAT(com, 'x') WHEN 5 THEN 'Elsewhere' ELSE com END AS com, spot, lon, lat
FROM {resolution}""",
    "spots": """
SELECT CASE p_partkey % 2 WHEN 0 THEN 'FRANCE' ELSE 'SPAIN' END AS co, p_brand AS com, p_name AS spot,
  MIN(p_partkey) AS id_spo,
  AVG(-10 + CAST((p_partkey * 7919) % 28000 AS DOUBLE) / 1000) AS lon_2,
  AVG(35 + CAST((p_partkey * 6007) % 20000 AS DOUBLE) / 1000) AS lat_2
FROM {part} GROUP BY 1, 2, 3""",
    "communes": """
SELECT CASE p_partkey % 2 WHEN 0 THEN 'FRANCE' ELSE 'SPAIN' END AS co, p_brand AS com, '44' AS dpt,
  MIN(p_partkey) AS id_co,
  AVG(-10 + CAST((p_partkey * 7919) % 28000 AS DOUBLE) / 1000) AS lon_2,
  AVG(35 + CAST((p_partkey * 6007) % 20000 AS DOUBLE) / 1000) AS lat_2
FROM {part} GROUP BY 1, 2""",
    "gazetteer": """
SELECT p_brand AS com, p_name AS spot, MIN(p_partkey) AS id_spo,
  AVG(-10 + CAST((p_partkey * 7919) % 28000 AS DOUBLE) / 1000) AS lon_2,
  AVG(35 + CAST((p_partkey * 6007) % 20000 AS DOUBLE) / 1000) AS lat_2
FROM {part} GROUP BY p_brand, p_name""",
    "corrections": """
SELECT c_custkey AS id, 'lon' AS field,
  CASE c_custkey % 5 WHEN 0 THEN 'negate' WHEN 1 THEN 'add' WHEN 2 THEN 'set' WHEN 3 THEN 'abs' ELSE 'swap' END AS op,
  CASE c_custkey % 5 WHEN 1 THEN -2.5e0 WHEN 2 THEN -0.703333e0 ELSE NULL END AS value
FROM {customer} WHERE c_custkey % 37 = 0""",
    "lineitem_price": """
SELECT l_orderkey AS id, l_linenumber, l_extendedprice AS wb_area_ha,
  CASE WHEN l_returnflag = 'R' THEN 'occupied' ELSE 'all' END AS status, 1 + l_discount AS wgt_co
FROM {lineitem}""",
    "sites": """
SELECT n_nationkey AS site_id, CASE WHEN n_nationkey % 2 = 0 THEN 'AYTFER' ELSE 'AYTFUL' END AS sp,
  -10 + 5.6e0 * (n_nationkey % 5) + 2.8e0 AS n_lon, 35 + 4e0 * FLOOR(n_nationkey / 5e0) + 1.5e0 AS n_lat,
  1 + n_nationkey % 4 AS n
FROM {nation}""",
    # raw field tables as text cells; places repeat the gazetteer's names, some with a slip
    "raw_cells": """
SELECT e.event_id AS n, e.event_type AS kind, e.ts AS stamp,
  CASE WHEN e.event_id % 31 = 0 THEN 'ANACRE' WHEN e.user_id % 2 = 0 THEN 'AYTFER' ELSE 'AYTFUL' END AS espece,
  CASE e.user_id % 6 WHEN 0 THEN '44' WHEN 1 THEN '53' WHEN 2 THEN '01' WHEN 3 THEN '77' WHEN 4 THEN '89' ELSE '99' END AS departement,
  CASE WHEN e.event_id % 37 = 0 THEN NULL ELSE CONCAT('R', CAST(e.user_id AS STRING)) END AS bague,
  CASE WHEN e.event_id % 5 = 4 THEN 'AUTRE' ELSE 'BAGUAGE' END AS action,
  CASE WHEN e.event_id % 4 = 0 THEN NULL ELSE e.ts END AS heure,
  CASE WHEN e.event_id % 6 = 5 THEN NULL ELSE CONCAT(CASE WHEN e.event_id % 2 = 0 THEN '-' ELSE '' END, CAST(e.event_id % 10 AS STRING)) END AS long_deg,
  CAST((e.event_id * 7) % 62 AS STRING) AS long_min, CONCAT(CAST((e.event_id * 11) % 60 AS STRING), ',5') AS long_sec,
  CAST(42 + e.event_id % 10 AS STRING) AS lat_deg, CAST((e.event_id * 3) % 60 AS STRING) AS lat_min, '30' AS lat_sec,
  CASE e.event_id % 7 WHEN 0 THEN 'Femelle' WHEN 1 THEN 'M' ELSE '?' END AS sexe,
  CASE e.event_id % 5 WHEN 0 THEN '+1A' WHEN 1 THEN '1A' WHEN 2 THEN 'PUL' ELSE '2A' END AS age,
  CASE p.p_partkey % 2 WHEN 0 THEN 'France' ELSE 'Spain' END AS pays,
  CASE WHEN e.event_id % 13 = 0 THEN 'Elsewhere' ELSE p.p_brand END AS commune,
  CASE e.event_id % 8 WHEN 0 THEN CONCAT(p.p_name, 's') WHEN 1 THEN NULL ELSE p.p_name END AS lieudit,
  CASE WHEN e.event_id % 6 = 0 THEN NULL WHEN e.event_id % 10 = 1 THEN CONCAT('M', CAST(e.user_id + 1 AS STRING))
    ELSE CONCAT('M', CAST(e.user_id AS STRING)) END AS marque,
  CAST(e.value AS STRING) AS poids
FROM {events} e CROSS JOIN (SELECT COUNT(*) AS parts FROM {part}) n JOIN {part} p ON p.p_partkey = 1 + e.event_id % n.parts""",
    # a cleaned dataset over several years: captures and resightings of the same individuals
    "dataset": """
SELECT o_orderkey AS id, c_custkey AS ring, CASE WHEN o_orderkey % 5 = 0 THEN 'BAGUAGE' ELSE 'CONTROLE' END AS obs,
  o_orderdate AS datetime, CASE c_custkey % 2 WHEN 0 THEN 'AYTFER' ELSE 'AYTFUL' END AS sp,
  CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'fem' ELSE 'mal' END AS sex,
  CASE c_custkey % 4 WHEN 0 THEN '1A' WHEN 1 THEN '2A' ELSE '+1A' END AS age,
  -10 + CAST(((c_custkey * 7919) + CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE (o_orderkey * 131) % 6000 END) % 28000 AS DOUBLE) / 1000 AS lon,
  35 + CAST(((c_custkey * 6007) + CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE (o_orderkey * 173) % 4000 END) % 20000 AS DOUBLE) / 1000 AS lat,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(c_nationkey AS STRING) END AS co,
  CASE c_custkey % 3 WHEN 0 THEN '44' WHEN 1 THEN '53' ELSE '77' END AS dpt, 3 AS nobs
FROM {orders} JOIN {customer} ON c_custkey = o_custkey""",
    # projected boxes in metres: neighbours in a row touch, lie 500 m apart or 2,500 m apart
    "water_edges": box_edges("wb_id, code", """
    SELECT s_suppkey AS wb_id,
      CASE CAST(FLOOR(s_suppkey / 20e0) AS INT) % 6 WHEN 0 THEN 411 WHEN 1 THEN 512 WHEN 2 THEN 412
        WHEN 3 THEN 521 WHEN 4 THEN 511 ELSE 523 END AS code,
      4e6 + 3e3 * (s_suppkey % 20) AS xa,
      4e6 + 3e3 * (s_suppkey % 20) + CASE s_suppkey % 3 WHEN 0 THEN 3e3 WHEN 1 THEN 2.5e3 ELSE 5e2 END AS xb,
      2e6 + 6e3 * FLOOR(s_suppkey / 20e0) AS ya, 2e6 + 6e3 * FLOOR(s_suppkey / 20e0) + 2e3 AS yb
    FROM {supplier}"""),
    # the same number of boxes in degrees, for points in longitude and latitude
    "lake_edges": box_edges("wb_id, sys_id", """
    SELECT s_suppkey AS wb_id, s_nationkey AS sys_id,
      -10 + CAST((s_suppkey * 4211) % 28000 AS DOUBLE) / 1000 AS xa,
      -10 + CAST((s_suppkey * 4211) % 28000 AS DOUBLE) / 1000 + 2e-1 + 1e-1 * (s_suppkey % 3) AS xb,
      35 + CAST((s_suppkey * 3571) % 20000 AS DOUBLE) / 1000 AS ya,
      35 + CAST((s_suppkey * 3571) % 20000 AS DOUBLE) / 1000 + 2e-1 AS yb
    FROM {supplier}"""),
}


class Tables:
    """Base tables and views of one data folder, as attributes or by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            text = VIEWS[name]
            used = {n: getattr(self, n) for n in set(re.findall(r"\{(\w+)\}", text))}
            return self.spark.sql(text, **used)
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def as_plain_sql(text: str) -> str:
    """SQL over the base tables alone: every view named as ``{view}`` becomes a common table."""
    needed: list[str] = []

    def visit(body: str) -> None:
        for name in re.findall(r"\{(\w+)\}", body):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(text)
    plain = lambda body: re.sub(r"\{(\w+)\}", r"\1", body)
    if not needed:
        return plain(text)
    ctes = ",\n".join(f"{n} AS ({plain(VIEWS[n])})" for n in needed)
    return f"WITH {ctes}\nSELECT * FROM ({plain(text)}) AS result"
