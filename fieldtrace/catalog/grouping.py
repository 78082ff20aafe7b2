"""Timelines, aggregates, ordered choices and sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.catalog import query
from fieldtrace.functions.nullsafe import strict_mean
from fieldtrace.functions.time import SEASONS, level_rank, season
from fieldtrace.operators.keyed import first_per_key, with_group_values
from fieldtrace.operators.ranks import appearance_codes, quantiles, running_total
from fieldtrace.operators.timeline import first_attributes, gate_timeline, reconciliation

_GATE = """
SELECT *, COUNT(*) OVER (PARTITION BY ring) AS nobs, BOOL_OR(obs = 'REPRISE') OVER (PARTITION BY ring) AS reprise FROM (
  SELECT *, SUM(CASE WHEN obs = 'REPRISE' THEN 1 ELSE 0 END) OVER (PARTITION BY ring ORDER BY datetime, id) AS e FROM (
    SELECT *, SUM(CASE WHEN obs = 'BAGUAGE' THEN 1 ELSE 0 END) OVER (PARTITION BY ring ORDER BY datetime, id) AS s
    FROM {timeline}) a WHERE s > 0) b WHERE e = 0 OR obs = 'REPRISE'"""


@query("W6 W7", f"SELECT id, ring, datetime, obs, sp, wgh, nobs, reprise FROM ({_GATE}) g")
def timeline_gate(t):
    return gate_timeline(t.timeline).select("id", "ring", "datetime", "obs", "sp", "wgh", "nobs", "reprise")


@query("W7 A7", f"SELECT DISTINCT ring, nobs, reprise FROM ({_GATE}) g")
def gated_sizes(t):
    return gate_timeline(t.timeline).groupBy("ring").agg(
        F.first("nobs").alias("nobs"), F.bool_or(F.col("obs") == "REPRISE").alias("reprise"))


@query("W8", """
SELECT id, ring, obs, FIRST_VALUE(sp) OVER (PARTITION BY ring ORDER BY datetime, id) AS sp FROM {timeline}""")
def attributes_of_first_event(t):
    return first_attributes(t.timeline, ["sp"]).select("id", "ring", "obs", "sp")


@query("A9", """
WITH c AS (SELECT ring FROM {timeline} WHERE obs = 'BAGUAGE'),
s AS (SELECT DISTINCT ring FROM {timeline} WHERE obs = 'CONTROLE'),
r AS (SELECT DISTINCT ring FROM {timeline} WHERE obs = 'REPRISE')
SELECT COUNT(*) AS captured, COUNT(*) FILTER (ring IN (SELECT ring FROM s)) AS seen_again,
  COUNT(*) FILTER (ring IN (SELECT ring FROM r)) AS recovered,
  COUNT(*) FILTER (ring IN (SELECT ring FROM s) AND ring IN (SELECT ring FROM r)) AS both,
  COUNT(*) FILTER (ring IN (SELECT ring FROM s) OR ring IN (SELECT ring FROM r)) AS either,
  COUNT(*) FILTER (ring NOT IN (SELECT ring FROM s) AND ring NOT IN (SELECT ring FROM r)) AS neither FROM c""")
def reconciliation_counts(t):
    e = t.timeline
    kind = lambda k: F.col("obs") == k
    return reconciliation(e.where(kind("BAGUAGE")), e.where(kind("CONTROLE")), e.where(kind("REPRISE")))


@query("A1", "SELECT sp, obs, COUNT(*) AS n FROM {timeline} GROUP BY sp, obs")
def count_by_keys(t):
    return t.timeline.groupBy("sp", "obs").agg(F.count(F.lit(1)).alias("n"))


@query("A5", """
SELECT obs, ROUND(AVG(n), 6) AS mean_n FROM (SELECT ring, sp, obs, COUNT(*) AS n FROM {timeline} GROUP BY ALL) x GROUP BY obs""")
def mean_of_counts(t):
    counts = t.timeline.groupBy("ring", "sp", "obs").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("obs").agg(F.round(strict_mean("n"), 6).alias("mean_n"))


@query("A7", """
SELECT ring, BOOL_OR(obs = 'REPRISE') AS reprise, MAX(CASE WHEN wgh > 100 THEN 1 ELSE 0 END) AS heavy FROM {timeline} GROUP BY ring""")
def any_per_group(t):
    return t.timeline.groupBy("ring").agg(F.bool_or(F.col("obs") == "REPRISE").alias("reprise"),
                                          F.max(F.when(F.col("wgh") > 100, 1).otherwise(0)).alias("heavy"))


@query("A12", """
SELECT status, q_id, ROUND(LIST_AGGREGATE([QUANTILE_CONT(wb_area_ha, [0, 1/7e0, 2/7e0, 3/7e0, 4/7e0, 5/7e0, 6/7e0, 1])[q_id + 1]], 'first'), 6) AS quantile
FROM {lineitem_price}, (SELECT CAST(i AS INT) AS q_id FROM range(0, 8) r(i)) q GROUP BY status, q_id""")
def exact_quantiles(t):
    q = quantiles(t.lineitem_price, ["status"], "wb_area_ha", [k / 7 for k in range(8)])
    return q.select("status", "q_id", F.round("quantile", 6).alias("quantile"))


@query("A13 W11", """
SELECT id, ROUND(wgt_co * (SELECT COUNT(*) FROM {seasonal_orders}) / (SELECT SUM(wgt_co) FROM {seasonal_orders}), 6) AS wgt,
  ROUND(dist_pt_km / (SELECT MAX(dist_pt_km) FROM {seasonal_orders}), 6) AS rel FROM {seasonal_orders}""")
def share_weights(t):
    s = t.seasonal_orders
    whole = s.agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum("wgt_co").alias("w"),
                           F.max("dist_pt_km").alias("m")).alias("all")).scalar()
    return s.select("id", F.round(F.col("wgt_co") * whole["n"] / whole["w"], 6).alias("wgt"),
                    F.round(F.col("dist_pt_km") / whole["m"], 6).alias("rel"))


@query("W2 O4", """
SELECT ring, obs, id, wgh FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ring, obs ORDER BY datetime, id) AS rn FROM {timeline}) x WHERE rn = 1""")
def first_row_per_key(t):
    return first_per_key(t.timeline, ["ring", "obs"], ["datetime", "id"]).select("ring", "obs", "id", "wgh")


@query("W5", """
SELECT ring, id, ROUND(gap, 6) AS gap FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ring ORDER BY ROUND(gap, 6), id) AS rn FROM (
  SELECT *, ABS(dist_pt_km - AVG(dist_pt_km) OVER (PARTITION BY ring)) AS gap FROM {seasonal_orders}) a) b WHERE rn = 1""")
def nearest_to_group_mean(t):
    rows = with_group_values(t.seasonal_orders, ["ring"], avg=strict_mean("dist_pt_km"))
    rows = rows.withColumn("gap", F.round(F.abs(F.col("dist_pt_km") - F.col("avg")), 6))
    return first_per_key(rows, ["ring"], ["gap", "id"]).select("ring", "id", "gap")


@query("W2", """
SELECT id, ROUND(SUM(wgh) OVER (PARTITION BY ring ORDER BY datetime, id), 4) AS upto FROM {timeline}""")
def running_sum(t):
    rows = t.timeline.select("id", "ring", "datetime", "wgh")
    return running_total(rows, ["ring"], ["datetime", "id"], "wgh", "upto").select("id", F.round("upto", 4).alias("upto"))


@query("W13", """
SELECT com, ROW_NUMBER() OVER (ORDER BY first) AS id_co FROM (SELECT com, MIN(id) AS first FROM {resolution} GROUP BY com) x""")
def category_codes(t):
    return appearance_codes(t.resolution, "com", "id", "id_co")


@query("O1 O2", """
SELECT sp, ring, datetime, id FROM {timeline} ORDER BY sp NULLS LAST, ring DESC NULLS LAST, datetime, id""")
def sort_nulls_last(t):
    return t.timeline.select("sp", "ring", "datetime", "id").orderBy(
        F.col("sp").asc_nulls_last(), F.col("ring").desc_nulls_last(), F.col("datetime").asc_nulls_last(), "id")


_SEASON = """CASE WHEN d BETWEEN 106 AND 182 THEN 'repro' WHEN d BETWEEN 183 AND 244 THEN 'mue' WHEN d BETWEEN 245 AND 305 THEN 'post-mue'
  WHEN d BETWEEN 306 AND 320 THEN 'départ_hivernage' WHEN d >= 321 OR d <= 46 THEN 'hivernage' ELSE 'départ_repro' END"""


@query("O3 F12", f"""
SELECT id, {_SEASON} AS period, CASE WHEN d BETWEEN 106 AND 182 THEN 0 WHEN d BETWEEN 183 AND 244 THEN 1 WHEN d BETWEEN 245 AND 305 THEN 2
  WHEN d BETWEEN 306 AND 320 THEN 3 WHEN d >= 321 OR d <= 46 THEN 4 ELSE 5 END AS level
FROM (SELECT id, DAYOFYEAR(datetime) AS d FROM {{seasonal_orders}}) x ORDER BY level, id""")
def sort_by_level(t):
    period = season("datetime")
    rows = t.seasonal_orders.select("id", period.alias("period"))
    return rows.withColumn("level", level_rank("period", SEASONS)).orderBy("level", "id")
