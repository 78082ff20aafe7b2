"""Reading, writing, numbering and literal tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldtrace.catalog import query
from fieldtrace.functions.codes import COUNTRY_CODES
from fieldtrace.operators.joins import natural_join
from fieldtrace.operators.keyed import nested, unnested
from fieldtrace.operators.ranks import row_numbers
from fieldtrace.sources.store import stage_root
from fieldtrace.sources.tables import (
    null_tokens_to_null, read_dataset, read_text_tables, with_provenance_id, write_dataset,
)


def _folder(t) -> str:
    return f"{stage_root(t.spark)}/fieldtrace-{uuid.uuid4().hex}"


@query("S1", """
SELECT id, NULLIF(NULLIF(bague, 'NA'), '') AS bague, sexe, age, action FROM {raw_obs}""")
def null_tokens(t):
    return null_tokens_to_null(t.raw_obs.drop("ts"))


@query("S1 P19", """
SELECT CAST(id AS VARCHAR) AS id, NULLIF(NULLIF(bague, 'NA'), '') AS bague, sexe, age, action,
  'CONTROLE' AS obs, CAST(NULL AS DOUBLE) AS wgh FROM {raw_obs}""")
def text_table_import(t):
    path, cols = _folder(t), ["id", "bague", "sexe", "age", "action"]
    t.raw_obs.select(*cols).write.option("header", True).csv(path)
    table = read_text_tables(t.spark, {"t_capture": path}, {"t_capture": cols})["t_capture"]
    return table.withColumns({"obs": F.lit("CONTROLE"), "wgh": F.lit(None).cast("double")})


@query("S2 W9 P22", """
SELECT CONCAT(CAST(ROW_NUMBER() OVER (ORDER BY ts, id) AS VARCHAR), '_t_capture') AS pid, id AS event
FROM {raw_obs}""")
def provenance_ids(t):
    numbered = with_provenance_id(t.raw_obs.select("ts", F.col("id").alias("event")), "t_capture",
                                  ["ts", "event"])
    return numbered.select("id", "event").toDF("pid", "event")


@query("S3 S5", "SELECT id, ring, obs, wgh FROM {timeline} WHERE obs = 'REPRISE'")
def dataset_round_trip(t):
    path = _folder(t)
    write_dataset(t.timeline, path)
    return read_dataset(t.spark, path).where(F.col("obs") == "REPRISE").select("id", "ring", "obs", "wgh")


@query("S4", "SELECT * FROM {water_edges} WHERE code IN (411, 512)")
def polygon_layer(t):
    path = _folder(t)
    write_dataset(t.water_edges, path)
    return read_dataset(t.spark, path).where(F.col("code").isin(411, 512))


@query("S7", """
SELECT nes_reg, sp, COUNT(*) AS n, ROUND(SUM(dist_pt_km), 2) AS km FROM {seasonal_orders} GROUP BY nes_reg, sp""")
def output_per_group(t):
    path = _folder(t)
    write_dataset(t.seasonal_orders, path, ["nes_reg", "sp"])
    back = read_dataset(t.spark, path)
    return back.groupBy("nes_reg", "sp").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("dist_pt_km"), 2).alias("km"))


@query("S6 J4 P19", """
SELECT COALESCE(r.com, f.com) AS com, r.n, f.lon, f.lat
FROM (SELECT com, COUNT(*) AS n FROM {resolution} GROUP BY com) r
FULL JOIN (SELECT * FROM (VALUES ('Brand#1', -0.13032148874992358e0, 47.35971150199786e0),
  ('Brand#2', 4.527200043337543e0, 52.34632019544103e0), ('NOWHERE', 2.5861804820696053e0, 47.35229176310093e0))
  AS v(com, lon, lat)) f ON r.com = f.com""")
def literal_gazetteer_full_join(t):
    found = t.spark.createDataFrame(
        [("Brand#1", -0.13032148874992358, 47.35971150199786), ("Brand#2", 4.527200043337543, 52.34632019544103),
         ("NOWHERE", 2.5861804820696053, 47.35229176310093)], "com string, lon double, lat double")
    sized = t.resolution.groupBy("com").agg(F.count(F.lit(1)).alias("n"))
    return natural_join(sized, found, "full", expect=["com"])


@query("S6 P16 F6", """
SELECT id, CASE code WHEN 'ER' THEN 'U.K. OF GREAT BRITAIN AND NORTHERN IRELAND' WHEN 'FR' THEN 'FRANCE'
  WHEN 'HE' THEN 'SWITZERLAND' WHEN 'UK' THEN 'UKRAINE' ELSE code END AS country
FROM (SELECT id, CASE id % 5 WHEN 0 THEN 'ER' WHEN 1 THEN 'FR' WHEN 2 THEN 'HE' WHEN 3 THEN 'UK' ELSE 'ZZ' END AS code
  FROM {geo_customers}) x""")
def country_code_dimension(t):
    codes = t.spark.createDataFrame(list(COUNTRY_CODES.items()), "code string, country string")
    k = F.col("id") % 5
    rows = t.geo_customers.select(
        "id", F.when(k == 0, "ER").when(k == 1, "FR").when(k == 2, "HE").when(k == 3, "UK").otherwise("ZZ").alias("code"))
    named = rows.join(F.broadcast(codes), "code", "left")  # a fixed list of 26 codes
    return named.select("id", F.coalesce("country", "code").alias("country"))


@query("W9", """
SELECT id, ring, ROW_NUMBER() OVER (PARTITION BY ring ORDER BY datetime, id) AS visit FROM {timeline}""")
def row_ids_per_group(t):
    rows = t.timeline.select("id", "ring", "datetime")
    return row_numbers(rows, ["ring"], ["datetime", "id"], "visit").select("id", "ring", "visit")


@query("A11", """
SELECT ring, part, CAST(COUNT(*) AS INT) AS part_rows, STRING_AGG(CAST(id AS VARCHAR), ',' ORDER BY n) AS ids
FROM (SELECT ring, id, n, CAST(FLOOR((n - 1) / 4) AS BIGINT) AS part
  FROM (SELECT ring, id, ROW_NUMBER() OVER (PARTITION BY ring ORDER BY datetime, id) AS n FROM {timeline}) x) y GROUP BY ring, part""")
def nest_rows(t):
    packed = nested(t.timeline.select("ring", "id", "datetime"), ["ring"], ["datetime", "id"], rows_per_part=4)
    ids = F.array_join(F.transform("data", lambda x: x["id"].cast("string")), ",")
    return packed.select("ring", "part", "part_rows", ids.alias("ids"))


@query("A11", "SELECT ring, id, obs, wgh FROM {timeline}")
def unnest_rows(t):
    rows = t.timeline.select("ring", "id", "obs", "wgh")
    return unnested(nested(rows, ["ring"], ["id"], rows_per_part=64))
