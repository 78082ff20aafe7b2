"""Winters, months, nesting seasons and map layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.catalog import query
from fieldtrace.functions import time
from fieldtrace.operators.keyed import first_per_key
from fieldtrace.plans.layers import layer_groups
from fieldtrace.plans.monthly import migration_rates, monthly_records

_WINTER = "YEAR(datetime) - CASE WHEN MONTH(datetime) < 7 THEN 1 ELSE 0 END"
_BACK = "CASE WHEN DAY(CAST(datetime AS DATE) - INTERVAL 1 MONTH) = DAY(datetime) THEN YEAR(CAST(datetime AS DATE) - INTERVAL 1 MONTH) END"


@query("F13", f"""
SELECT id, CAST({_WINTER} AS INT) AS winter,
  CAST(ABS(DATE_DIFF('day', MAKE_DATE({_WINTER}, 12, 24), CAST(datetime AS DATE))) AS INT) AS gap FROM {{seasonal_orders}}""")
def winter_and_gap(t):
    return t.seasonal_orders.select("id", time.winter("datetime").alias("winter"), time.days_to_midwinter("datetime").alias("gap"))


@query("F14", f"SELECT id, CAST({_BACK} AS INT) AS winter FROM {{seasonal_orders}} WHERE MONTH(datetime) IN (1, 11, 12)")
def winter_by_month_shift(t):
    return t.seasonal_orders.where(F.month("datetime").isin(1, 11, 12)).select(
        "id", time.shifted_winter("datetime").alias("winter"))


@query("W3 F13 P14", f"""
SELECT ring, winter, id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ring, winter ORDER BY gap, id) AS rn FROM (
  SELECT ring, id, CAST({_WINTER} AS INT) AS winter, ABS(DATE_DIFF('day', MAKE_DATE({_WINTER}, 12, 24), CAST(datetime AS DATE))) AS gap
  FROM {{seasonal_orders}}) a WHERE gap < 40) b WHERE rn = 1""")
def closest_to_midwinter(t):
    rows = t.seasonal_orders.withColumns({"winter": time.winter("datetime"), "gap": time.days_to_midwinter("datetime")})
    return first_per_key(rows.where(F.col("gap") < time.WINTER_HALF_WIDTH), ["ring", "winter"], ["gap", "id"]).select(
        "ring", "winter", "id")


@query("W4 F11", """
SELECT ring, id, CAST(MONTH(datetime) AS INT) AS month FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ring, YEAR(datetime), MONTH(datetime)
  ORDER BY ABS(DAY(datetime) - 15), id) AS rn FROM {seasonal_orders}) x WHERE rn = 1""")
def closest_to_midmonth(t):
    return monthly_records(t.seasonal_orders).select("ring", "id", "month")


@query("A8 A7 F14 W4", f"""
SELECT nes_reg, sp, CAST(ROUND_EVEN(100.0 * SUM(mig) / COUNT(*), 0) AS DOUBLE) AS rate FROM (
  SELECT nes_reg, sp, ring, {_BACK} AS winter, MAX(CASE WHEN dist_pt_km > 250000 THEN 1 ELSE 0 END) AS mig
  FROM {{seasonal_orders}} WHERE MONTH(datetime) IN (1, 11, 12) GROUP BY 1, 2, 3, 4) x GROUP BY nes_reg, sp""")
def migration_rate(t):
    return migration_rates(t.seasonal_orders, distance="dist_pt_km", beyond=250000.0)


@query("F17", f"""
SELECT id, CASE WHEN age IN ('1A', '2A', 'pull') AND winter = YEAR(ringed) THEN 'je' ELSE 'ad' END AS age FROM (
  SELECT id, {_WINTER} AS winter, datetime - TO_DAYS(CAST(id % 500 AS INT)) AS ringed,
    CASE id % 4 WHEN 0 THEN '1A' WHEN 1 THEN '+1A' WHEN 2 THEN 'pul' ELSE '2A' END AS age FROM {{seasonal_orders}}) x""")
def age_class_in_winter(t):
    k = F.col("id") % 4
    rows = t.seasonal_orders.select(
        "id", time.winter("datetime").alias("winter"),
        (F.col("datetime") - F.make_dt_interval((F.col("id") % 500).cast("int"))).alias("ringed"),
        F.when(k == 0, "1A").when(k == 1, "+1A").when(k == 2, "pul").otherwise("2A").alias("age"))
    return rows.select("id", time.age_class("age", "winter", "ringed").alias("age"))


@query("P26 W13 O3 P24", """
SELECT id, sp || '~' || nes_reg || '~' || period AS gp, nes_reg AS gp_col, id_co FROM (
  SELECT *, CASE WHEN d >= 321 OR d <= 46 THEN 'hivernage' WHEN d BETWEEN 306 AND 320 THEN 'départ_hivernage' END AS period
  FROM (SELECT *, DAYOFYEAR(datetime) AS d FROM {seasonal_orders}) a) o
JOIN (SELECT nes_reg, ROW_NUMBER() OVER (ORDER BY f) AS id_co FROM (SELECT nes_reg, MIN(id) AS f FROM {seasonal_orders}
  WHERE sp = 'AYTFER' AND (DAYOFYEAR(datetime) >= 306 OR DAYOFYEAR(datetime) <= 46) GROUP BY nes_reg) y) c USING (nes_reg)
WHERE sp = 'AYTFER' AND period IS NOT NULL""")
def map_layers(t):
    rows = t.seasonal_orders.withColumn("period", time.season("datetime")).where(
        F.col("period").isin("hivernage", "départ_hivernage") & (F.col("sp") == "AYTFER"))
    return layer_groups(rows, ["sp", "nes_reg", "period"], "nes_reg").select("id", "gp", "gp_col", "id_co")
