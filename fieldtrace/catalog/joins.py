"""Joins, memberships, bins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtrace.catalog import query
from fieldtrace.operators.joins import (
    ceiling_level, drop_members, keep_members, natural_join, range_join, union_all,
)
from fieldtrace.operators.keyed import add_count
from fieldtrace.operators.records import (
    attach_positions, conflicting_attributes, consistent_pairs, duplicate_keys, mean_positions, merge_sources,
    pair_conflicts, reference_pairs, unlocated_places,
)


@query("J1", """
SELECT r.id, r.com, r.spot, g.id_spo, ROUND(g.lon_2, 6) AS lon_2 FROM {resolution} r
JOIN {gazetteer} g ON r.com IS NOT DISTINCT FROM g.com AND r.spot IS NOT DISTINCT FROM g.spot""")
def natural_inner_join(t):
    r = t.resolution.select("id", "com", "spot")
    g = t.gazetteer.select("com", "spot", "id_spo", F.round("lon_2", 6).alias("lon_2"))
    return natural_join(r, g, "inner", expect=["com", "spot"])


@query("J2", """
SELECT a.id, a.lon AS "lon.x", b.lon AS "lon.y", a.lat FROM {geo_customers} a
LEFT JOIN (SELECT id, lon FROM {resolution}) b ON a.id = b.id""")
def left_join_with_suffixes(t):
    return natural_join(t.geo_customers.drop("co"), t.resolution.select("id", "lon"), "left", on=["id"])


@query("J3 A5", """
SELECT w.mark, w.day, w.n, k.ring FROM (SELECT DISTINCT mark, ring FROM {pairs} WHERE obs = 'BAGUAGE' AND mark IS NULL) k
RIGHT JOIN (SELECT mark, day, COUNT(*) AS n FROM {pairs} GROUP BY mark, day) w ON k.mark IS NOT DISTINCT FROM w.mark""")
def right_join_null_keys(t):
    counts = t.pairs.groupBy("mark", "day").agg(F.count(F.lit(1)).alias("n"))
    unmarked = t.pairs.where((F.col("obs") == "BAGUAGE") & F.col("mark").isNull()).select("mark", "ring").distinct()
    return natural_join(unmarked, counts, "right", expect=["mark"])


@query("J4", """
SELECT COALESCE(a.ring, b.ring) AS ring, a.n_first, b.n_last
FROM (SELECT ring, COUNT(*) AS n_first FROM {timeline} WHERE obs = 'BAGUAGE' GROUP BY ring) a
FULL JOIN (SELECT ring, COUNT(*) AS n_last FROM {timeline} WHERE obs = 'REPRISE' GROUP BY ring) b ON a.ring = b.ring""")
def full_join(t):
    a = t.timeline.where(F.col("obs") == "BAGUAGE").groupBy("ring").agg(F.count(F.lit(1)).alias("n_first"))
    b = t.timeline.where(F.col("obs") == "REPRISE").groupBy("ring").agg(F.count(F.lit(1)).alias("n_last"))
    return natural_join(a, b, "full", expect=["ring"])


@query("J5", """
SELECT id, ring FROM {timeline} c WHERE obs = 'BAGUAGE' AND EXISTS (SELECT 1 FROM {timeline} r WHERE r.obs = 'REPRISE' AND r.ring = c.ring)""")
def semi_join(t):
    e = t.timeline
    return natural_join(e.where(F.col("obs") == "BAGUAGE").select("id", "ring"),
                        e.where(F.col("obs") == "REPRISE").select("ring").distinct(), "left_semi", expect=["ring"])


@query("J6", """
SELECT id, ring, mark FROM {pairs} c WHERE obs = 'CONTROLE' AND NOT EXISTS (
  SELECT 1 FROM {pairs} r WHERE r.obs = 'BAGUAGE' AND r.ring = c.ring AND r.mark IS NOT DISTINCT FROM c.mark)""")
def anti_join_null_keys(t):
    p = t.pairs
    return natural_join(p.where(F.col("obs") == "CONTROLE").select("id", "ring", "mark"),
                        p.where(F.col("obs") == "BAGUAGE").select("ring", "mark").distinct(), "left_anti",
                        expect=["ring", "mark"])


@query("J7", """
SELECT id, mark FROM {pairs} p WHERE obs = 'REPRISE' AND (mark IS NULL OR mark IN (
  SELECT mark FROM {pairs} WHERE obs = 'BAGUAGE'))""")
def membership_null_safe(t):
    p = t.pairs
    return keep_members(p.where(F.col("obs") == "REPRISE"), "mark", p.where(F.col("obs") == "BAGUAGE")).select("id", "mark")


@query("J7 P12", """
SELECT id, mark FROM {pairs} p WHERE obs = 'REPRISE' AND (mark IS NULL OR mark NOT IN (
  SELECT mark FROM {pairs} WHERE obs = 'BAGUAGE' AND mark IS NOT NULL))""")
def non_membership_keeps_null(t):
    p = t.pairs
    listed = p.where((F.col("obs") == "BAGUAGE") & F.col("mark").isNotNull())
    return drop_members(p.where(F.col("obs") == "REPRISE"), "mark", listed).select("id", "mark")


@query("J15", """
SELECT l.id, l.l_linenumber, l.wb_area_ha, b.bin FROM {lineitem_price} l JOIN (
  SELECT i AS bin, 15000.0 * i AS down, 15000.0 * (i + 1) - 1e-6 AS up FROM range(0, 8) r(i)) b
ON l.wb_area_ha >= b.down AND l.wb_area_ha <= b.up""")
def range_join_to_bins(t):
    bins = t.spark.range(8).select(F.col("id").alias("bin"), (15000.0 * F.col("id")).alias("down"),
                                   (15000.0 * (F.col("id") + 1) - 1e-6).alias("up"))
    rows = t.lineitem_price.select("id", "l_linenumber", "wb_area_ha")
    return range_join(rows, "wb_area_ha", bins, "down", "up").select(
        "id", "l_linenumber", "wb_area_ha", "bin")


@query("J16 J19", """
SELECT ring, n, CASE WHEN n <= 50 THEN 50 WHEN n <= 60 THEN 60 WHEN n <= 70 THEN 70 WHEN n <= 80 THEN 80 END AS lv,
  CASE WHEN n <= 50 THEN 1 WHEN n <= 60 THEN 2 WHEN n <= 70 THEN 3 WHEN n <= 80 THEN 4 END AS lv_id
FROM (SELECT ring, COUNT(*) AS n FROM {timeline} GROUP BY ring) x""")
def ceiling_lookup(t):
    level, place = ceiling_level("n", [50, 60, 70, 80])
    return t.timeline.groupBy("ring").agg(F.count(F.lit(1)).alias("n")).select(
        "ring", "n", level.alias("lv"), place.cast("int").alias("lv_id"))


@query("J18 J19", """
SELECT id, shift, -180 + CAST((id * 37) % 360 AS INT) + 360 * shift AS angle FROM {geo_customers}, (VALUES (-1), (0), (1)) AS s(shift)""")
def shifted_copies(t):
    shift = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    rows = t.geo_customers.select("id", shift.alias("shift"))
    return rows.withColumn("angle", -180 + ((F.col("id") * 37) % 360).cast("int") + 360 * F.col("shift"))


_KNOWN = "SELECT DISTINCT ring, mark FROM {pairs} WHERE obs = 'BAGUAGE' AND mark IS NOT NULL AND mark <> 'NON MARQUE'"


def _pair_sides(t):
    p = t.pairs
    refs = reference_pairs(p.where((F.col("obs") == "BAGUAGE") & (F.col("mark") != "NON MARQUE")))
    return p.where(F.col("obs") == "CONTROLE"), refs


@query("J20", f"""
SELECT c.id, c.ring, c.mark FROM {{pairs}} c LEFT JOIN ({_KNOWN}) k ON c.ring = k.ring AND c.mark = k.mark
WHERE c.obs = 'CONTROLE' AND (k.ring IS NOT NULL OR c.mark IS NULL OR c.mark LIKE '%MARQUE%')""")
def pair_consistency(t):
    controls, refs = _pair_sides(t)
    return consistent_pairs(controls, refs).select("id", "ring", "mark")


@query("J20 J6 W1 O2", f"""
WITH k AS ({_KNOWN}), s AS (SELECT c.id, c.ring, c.mark, COUNT(*) OVER (PARTITION BY c.ring) AS n FROM {{pairs}} c
  LEFT JOIN k ON c.ring = k.ring AND c.mark IS NOT DISTINCT FROM k.mark WHERE c.obs = 'CONTROLE' AND k.ring IS NULL)
SELECT s.id, s.ring, s.mark, s.n, k.mark AS reference FROM s LEFT JOIN k ON s.ring = k.ring
ORDER BY n DESC, ring, id""")
def pair_conflict_report(t):
    controls, refs = _pair_sides(t)
    report = pair_conflicts(controls, refs).select("id", "ring", "mark", "n", "reference")
    return report.orderBy(F.col("n").desc_nulls_last(), F.col("ring").asc_nulls_last(), F.col("id").asc_nulls_last())


@query("J21 W2", """
WITH known AS (SELECT DISTINCT ring FROM {pairs} WHERE obs = 'BAGUAGE' AND ring % 5 <> 0),
stacked AS (SELECT 0 AS src, * FROM {pairs} WHERE obs = 'CONTROLE' UNION ALL SELECT 1, * FROM {pairs} WHERE obs = 'REPRISE')
SELECT id, ring, day, obs FROM (SELECT s.*, ROW_NUMBER() OVER (PARTITION BY s.ring, s.day ORDER BY s.src, s.id) AS rn
  FROM stacked s JOIN known k ON s.ring = k.ring) x WHERE rn = 1""")
def merge_known_first_record(t):
    p = t.pairs
    known = p.where((F.col("obs") == "BAGUAGE") & (F.col("ring") % 5 != 0))
    merged = merge_sources([p.where(F.col("obs") == "CONTROLE"), p.where(F.col("obs") == "REPRISE")],
                           known, "ring", "day", "id")
    return merged.select("id", "ring", "day", "obs")


@query("J22", """
SELECT r.id, CASE WHEN p.id IS NOT NULL THEN p.plon ELSE r.lon END AS lon,
  CASE WHEN p.id IS NOT NULL THEN p.plat ELSE r.lat END AS lat, r.com, r.spot
FROM {resolution} r LEFT JOIN (SELECT id, lon + 1 AS plon, lat + 1 AS plat FROM {geo_customers} WHERE id % 2 = 0) p ON r.id = p.id
WHERE p.id IS NOT NULL OR (r.lon IS NOT NULL AND r.lat IS NOT NULL) OR (r.com IS NOT NULL AND r.spot IS NOT NULL)""")
def positions_with_fallback(t):
    table = t.geo_customers.where(F.col("id") % 2 == 0).select(
        "id", (F.col("lon") + 1).alias("lon"), (F.col("lat") + 1).alias("lat"))
    return attach_positions(t.resolution, table, ["id"]).select("id", "lon", "lat", "com", "spot")


@query("J23 A1", """
SELECT x.sys_id, x.n, s.area, s.n_wb FROM (SELECT co AS sys_id, COUNT(*) AS n FROM {geo_customers} GROUP BY co) x
LEFT JOIN (SELECT sys_id, ROUND(SUM(wb_area_ha), 4) AS area, COUNT(*) AS n_wb FROM {geo_suppliers} GROUP BY sys_id) s ON x.sys_id = s.sys_id""")
def water_system_attributes(t):
    counted = t.geo_customers.groupBy(F.col("co").alias("sys_id")).agg(F.count(F.lit(1)).alias("n"))
    systems = t.geo_suppliers.groupBy("sys_id").agg(
        F.round(F.sum("wb_area_ha"), 4).alias("area"), F.count(F.lit(1)).alias("n_wb"))
    return natural_join(counted, systems, "left", expect=["sys_id"])


@query("A2", "SELECT ring, day, COUNT(*) AS n FROM {pairs} GROUP BY ring, day HAVING COUNT(*) > 1")
def duplicate_key_report(t):
    return duplicate_keys(t.pairs, ["ring", "day"])


@query("A3", """
SELECT ring, COUNT(*) AS n FROM (SELECT DISTINCT ring, sp FROM {timeline}) x GROUP BY ring HAVING COUNT(*) > 1""")
def attribute_conflicts(t):
    return conflicting_attributes(t.timeline, "ring", "sp")


@query("A3 J5 O1", """
SELECT id, ring, mark FROM {pairs} WHERE ring IN (SELECT ring FROM (SELECT DISTINCT ring, mark FROM {pairs}) x
  GROUP BY ring HAVING COUNT(*) > 3) ORDER BY ring, id""")
def conflicting_rows(t):
    bad = conflicting_attributes(t.pairs, "ring", "mark").where(F.col("n") > 3)
    return keep_members(t.pairs, "ring", bad).select("id", "ring", "mark").orderBy("ring", "id")


@query("A4", """
SELECT com, COUNT(lon) AS n, CASE WHEN COUNT(*) = COUNT(lon) THEN ROUND(AVG(lon), 6) END AS lon,
  CASE WHEN COUNT(*) = COUNT(lat) THEN ROUND(AVG(lat), 6) END AS lat, ARG_MIN(raw, id) AS raw
FROM (SELECT *, COALESCE(spot, 'none') AS raw, com || CAST(id % 7 AS VARCHAR) AS k FROM {resolution}) x GROUP BY com, k""")
def mean_position_first_raw(t):
    r = t.resolution.withColumns({"raw": F.coalesce("spot", F.lit("none")),
                                  "k": F.concat("com", (F.col("id") % 7).cast("string"))})
    n = r.groupBy("com", "k").agg(F.count("lon").alias("n"))
    means = mean_positions(r, ["com", "k"], "id", raws=["raw"])
    return natural_join(means, n, "inner", expect=["com", "k"]).select(
        "com", "n", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "raw")


@query("A6", """
SELECT com, spot, CAST(SUM(pos) AS BIGINT) AS pos, CAST(SUM(n) AS BIGINT) AS n FROM (
  SELECT com, spot, CASE WHEN lon IS NULL OR lat IS NULL THEN 0 ELSE 1 END AS pos, COUNT(*) AS n
  FROM {resolution} GROUP BY ALL) x GROUP BY com, spot HAVING SUM(pos) = 0""")
def places_without_position(t):
    return unlocated_places(t.resolution, ("com", "spot"))


@query("A6 J7 F3", """
WITH u AS (SELECT com || spot AS loc FROM {resolution} GROUP BY com, spot HAVING MAX(CASE WHEN lon IS NULL THEN 0 ELSE 1 END) = 0)
SELECT id FROM {resolution} WHERE com || spot IN (SELECT loc FROM u) OR (com || spot IS NULL AND EXISTS (SELECT 1 FROM u WHERE loc IS NULL))""")
def records_without_position(t):
    # the key has no separator, so ("AB", "C") and ("A", "BC") are the same place
    places = unlocated_places(t.resolution, ("com", "spot")).select(F.concat("com", "spot").alias("loc"))
    return keep_members(t.resolution.withColumn("loc", F.concat("com", "spot")), "loc", places).select("id")


@query("U1", """
SELECT id, ring, obs, sp, CAST(NULL AS VARCHAR) AS mark FROM {timeline} WHERE obs = 'BAGUAGE'
UNION ALL SELECT id, ring, obs, NULL, mark FROM {pairs} WHERE obs = 'REPRISE'""")
def union_by_name(t):
    a = t.timeline.where(F.col("obs") == "BAGUAGE").select("id", "ring", "obs", "sp")
    b = t.pairs.where(F.col("obs") == "REPRISE").select("mark", "obs", "ring", "id")
    return union_all(a, b)


@query("U3 A10", """
SELECT ring, sp FROM {timeline} WHERE obs = 'BAGUAGE' UNION SELECT ring, sp FROM {timeline} WHERE obs = 'REPRISE'""")
def union_distinct(t):
    e = t.timeline
    return union_all(*[e.where(F.col("obs") == o).select("ring", "sp") for o in ("BAGUAGE", "REPRISE")]).distinct()


@query("U5", """
SELECT 0 AS lv, CAST(0 AS BIGINT) AS n UNION ALL SELECT CAST(LEAST(n, 100) AS INT), COUNT(*) FROM (
  SELECT ring, COUNT(*) AS n FROM {timeline} GROUP BY ring) x GROUP BY 1 ORDER BY lv""")
def sentinel_row(t):
    counts = t.timeline.groupBy("ring").agg(F.count(F.lit(1)).alias("n"))
    levels = counts.groupBy(F.least("n", F.lit(100)).cast("int").alias("lv")).agg(F.count(F.lit(1)).alias("n"))
    first = t.spark.createDataFrame([(0, 0)], "lv int, n bigint")
    return union_all(first, levels).orderBy("lv")


@query("W1 A1", "SELECT id, ring, COUNT(*) OVER (PARTITION BY ring) AS n FROM {timeline}")
def count_on_rows(t):
    return add_count(t.timeline.select("id", "ring"), ["ring"], "n")


@query("A10", """
SELECT COUNT(DISTINCT ring) AS rings, COUNT(DISTINCT sp) AS species, COUNT(DISTINCT obs) AS kinds FROM {timeline}""")
def distinct_counts(t):
    return t.timeline.agg(F.countDistinct("ring").alias("rings"), F.countDistinct("sp").alias("species"),
                          F.countDistinct("obs").alias("kinds"))
