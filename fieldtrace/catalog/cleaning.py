"""Projections, filters, codes, coordinates and hand corrections."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import functions as F

from fieldtrace.catalog import query
from fieldtrace.functions import codes, nullsafe, text, time
from fieldtrace.operators.corrections import corrected, replace_rows, rules_for
from fieldtrace.operators.joins import drop_members, keep_members, union_all
from fieldtrace.operators.projection import across, by_position, each, named_like, swapped


@query("P1 P4", "SELECT id, action AS obs, bague AS ring, sexe FROM {raw_obs}")
def select_and_rename(t):
    return t.raw_obs.drop("ts").select("id", F.col("action").alias("obs"), F.col("bague").alias("ring"), "sexe")


@query("P2", "SELECT id, long_deg, lat_deg, lat_min FROM {dms_points}")
def select_by_position(t):
    return by_position(t.dms_points, (1, 2), (5, 6))


@query("P3", "SELECT id, long_deg, long_min, long_sec FROM {dms_points}")
def select_by_pattern(t):
    d = t.dms_points
    keep = named_like(d, prefixes=["ID", "Long"], parts=["LONG_S"])
    return d.select(*keep).drop(*named_like(d, prefixes=["LAT"]))


@query("P5", "SELECT id, lat AS lon, lon AS lat FROM {geo_customers}")
def swap_columns(t):
    return swapped(t.geo_customers.drop("co"), "lon", "lat")


@query("P6 P24", """
SELECT id, bague, action FROM {raw_obs} WHERE action IN ('signup', 'purchase') AND bague <> 'NA'""")
def in_list_filter(t):
    return t.raw_obs.where(
        nullsafe.is_in("action", ["signup", "purchase"]) & (F.col("bague") != "NA")).select("id", "bague", "action")


@query("P6", "SELECT id, action FROM {raw_obs} WHERE action IS NULL OR action = 'view'")
def in_list_filter_with_null(t):
    return t.raw_obs.where(nullsafe.is_in("action", ["view", None])).select("id", "action")


@query("P7", "SELECT id, sexe, age FROM {raw_obs} WHERE action IS NOT NULL AND (sexe IS NULL OR age IS NULL)")
def null_filters(t):
    return t.raw_obs.where(F.col("action").isNotNull() & nullsafe.any_null("sexe", "age")).select("id", "sexe", "age")


_DMS = """
SELECT id, CASE WHEN long_deg LIKE '%-%' THEN -1 ELSE 1 END AS side,
  ABS(TRY_CAST(REGEXP_REPLACE(long_deg, '[,:;]', '.') AS DOUBLE)) AS d,
  ABS(TRY_CAST(REGEXP_REPLACE(long_min, '[,:;]', '.') AS DOUBLE)) AS m,
  ABS(TRY_CAST(REGEXP_REPLACE(long_sec, '[,:;]', '.') AS DOUBLE)) AS s,
  ABS(TRY_CAST(REGEXP_REPLACE(lat_deg, '[,:;]', '.') AS DOUBLE)) AS d2,
  ABS(TRY_CAST(REGEXP_REPLACE(lat_min, '[,:;]', '.') AS DOUBLE)) AS m2,
  ABS(TRY_CAST(REGEXP_REPLACE(lat_sec, '[,:;]', '.') AS DOUBLE)) AS s2
FROM {dms_points}"""


def _text_of(c: str) -> str:
    return f"CASE WHEN {c} = FLOOR({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"


@query("P8", f"""
SELECT id FROM ({_DMS}) x WHERE NOT (COALESCE(d > 90, TRUE) OR COALESCE(m < 0 OR m >= 60, TRUE)
  OR COALESCE(s < 0 OR s >= 60, TRUE) OR COALESCE(d2 > 90, TRUE) OR COALESCE(m2 >= 60, TRUE) OR COALESCE(s2 >= 60, TRUE))""")
def coordinate_validity(t):
    ok = text.valid_dms("long_deg", "long_min", "long_sec") & text.valid_dms("lat_deg", "lat_min", "lat_sec")
    return t.dms_points.where(ok).select("id")


@query("P9", """
SELECT id, lon, lat FROM {geo_customers} WHERE lon >= 0 AND lon <= 10 AND lat >= 40 AND lat <= 50""")
def bounding_box(t):
    return t.geo_customers.where(text.in_box("lon", "lat", (0, 10), (40, 50))).select("id", "lon", "lat")


@query("P10", """
SELECT id, (spot IS NULL OR lon IS NULL) AS some_missing, (spot IS NULL AND lon IS NULL) AS all_missing
FROM {resolution} WHERE com IS NOT NULL""")
def any_or_all_missing(t):
    c = [F.col(x).isNull() for x in ("spot", "lon")]
    return t.resolution.where(nullsafe.all_present("com")).select(
        "id", reduce(or_, c).alias("some_missing"), reduce(and_, c).alias("all_missing"))


@query("P11 F1", """
SELECT id, mark, (mark LIKE 'M1%') AS starts, REGEXP_MATCHES(mark, '^(?:NON|M2)') AS either
FROM {pairs} WHERE mark IS NULL OR REGEXP_MATCHES(mark, 'MARQUE|[13]$')""")
def regex_filter(t):
    keep = F.col("mark").isNull() | text.contains("mark", "MARQUE|[13]$")
    return t.pairs.where(keep).select(
        "id", "mark", text.starts_with("mark", "M1").alias("starts"), text.starts_with("mark", "NON|M2").alias("either"))


@query("P12 J6", """
SELECT id, ring FROM {timeline} WHERE id NOT IN (SELECT id FROM {corrections})""")
def exclude_ids(t):
    return drop_members(t.timeline, "id", t.corrections).select("id", "ring")


@query("P13 F11", """
SELECT id, CAST(YEAR(datetime) AS INT) AS y, CAST(MONTH(datetime) AS INT) AS m, CAST(DAY(datetime) AS INT) AS d,
  CAST(DAYOFYEAR(datetime) AS INT) AS yd, CAST(HOUR(datetime) AS INT) AS h, CAST(MINUTE(datetime) AS INT) AS mi, CAST(datetime AS DATE) AS dt
FROM {seasonal_orders} WHERE DAYOFYEAR(datetime) BETWEEN 106 AND 213 AND YEAR(datetime) BETWEEN 1995 AND 1998""")
def day_window_and_years(t):
    d = F.col("datetime")
    return t.seasonal_orders.where(
        time.in_days(d, time.NESTING_DAYS) & F.year(d).isin(list(range(1995, 1999)))).select(
        "id", F.year(d).alias("y"), F.month(d).alias("m"), F.dayofmonth(d).alias("d"), F.dayofyear(d).alias("yd"),
        F.hour(d).alias("h"), F.minute(d).alias("mi"), F.to_date(d).alias("dt"))


@query("P14", """
SELECT id, dist_pt_km FROM {seasonal_orders} WHERE mig = 1 AND dist_pt_km < 300000 AND (wgt_co > 2 OR dist_pt_km < 200000)""")
def threshold_filter(t):
    km = F.col("dist_pt_km")
    return t.seasonal_orders.where(
        (F.col("mig") == 1) & (km < 300000) & ((F.col("wgt_co") > 2) | (km < 200000))).select("id", "dist_pt_km")


@query("P15 P18", """
SELECT id, CASE WHEN action IS NULL THEN NULL WHEN action = 'signup' THEN 'BAGUAGE' ELSE 'CONTROLE' END AS obs,
  COALESCE(sexe, 'ind') AS sex, COALESCE(age, 'NA') AS age_text FROM {raw_obs}""")
def conditional_and_defaults(t):
    return t.raw_obs.select(
        "id", nullsafe.if_else(F.col("action") == "signup", F.lit("BAGUAGE"), F.lit("CONTROLE")).alias("obs"),
        nullsafe.default("sexe", "ind").alias("sex"), nullsafe.null_text("age").alias("age_text"))


@query("P16 F18", """
SELECT id, CASE WHEN sexe IN ('F', 'Femelle') THEN 'fem' WHEN sexe = 'M' THEN 'mal' ELSE 'ind' END AS sex,
  CASE WHEN REGEXP_MATCHES(age, '\\?') THEN 'ind' WHEN REGEXP_MATCHES(age, '\\+1') THEN '+1A'
    WHEN REGEXP_MATCHES(age, '\\+') THEN '+2A' WHEN REGEXP_MATCHES(age, '^(1|VOL)') THEN '1A'
    WHEN REGEXP_MATCHES(age, '^2') THEN '2A' WHEN age = 'PUL' THEN 'pul' ELSE 'ind' END AS age
FROM {raw_obs}""")
def sex_and_age_codes(t):
    return t.raw_obs.select("id", text.sex_code("sexe").alias("sex"), text.age_code("age").alias("age"))


@query("P17", """
SELECT id, co, FLOOR(lon) + 0.5e0 AS lon, FLOOR(lat) + 0.5e0 AS lat FROM {geo_customers}""")
def same_expression_across(t):
    return across(t.geo_customers, ["lon", "lat"], lambda c: F.floor(c) + F.lit(0.5))


@query("P20 U4", """
SELECT g.id, g.co, CASE c.op WHEN 'negate' THEN -g.lon WHEN 'add' THEN g.lon + c.value WHEN 'set' THEN c.value
    WHEN 'abs' THEN ABS(g.lon) WHEN 'swap' THEN g.lat ELSE g.lon END AS lon,
  CASE c.op WHEN 'swap' THEN g.lon ELSE g.lat END AS lat
FROM {geo_customers} g LEFT JOIN {corrections} c ON g.id = c.id""")
def rule_corrections(t):
    rules = t.corrections.withColumns({"seq": F.lit(1), "text": F.lit(None).cast("string")})
    return corrected(t.geo_customers, rules)


@query("P20 P21 J5", """
SELECT g.id, CASE WHEN f.id IS NULL THEN g.lon ELSE -1.65611111111111e0 END AS lon,
  CASE WHEN f.id IS NULL THEN g.lat ELSE 47.0841666666667e0 END AS lat,
  CASE WHEN f.id IS NULL THEN CAST(g.co AS VARCHAR) ELSE 'GRAND-LIEU' END AS co
FROM {geo_customers} g LEFT JOIN (SELECT id FROM {resolution} WHERE REGEXP_MATCHES(spot, 'ring|widget')) f ON g.id = f.id""")
def corrections_by_predicate(t):
    chosen = t.resolution.where(text.contains("spot", "ring|widget"))
    rules = rules_for(chosen, [("lon", "set", -1.65611111111111, None), ("lat", "set", 47.0841666666667, None),
                               ("co", "set", None, "GRAND-LIEU")])
    records = t.geo_customers.withColumn("co", F.col("co").cast("string"))
    return corrected(records, rules)


@query("P20", """
SELECT id, co, CASE id % 3 WHEN 0 THEN lat WHEN 1 THEN lat ELSE lon END AS lon,
  CASE id % 3 WHEN 0 THEN -lon WHEN 1 THEN lon + 41 ELSE lat END AS lat FROM {geo_customers}""")
def corrections_in_sequence(t):
    turned = rules_for(t.geo_customers.where(F.col("id") % 3 == 0), [("lon", "swap", None, None), ("lat", "negate", None, None)])
    moved = rules_for(t.geo_customers.where(F.col("id") % 3 == 1), [("lon", "add", 41.0, None), ("lon", "swap", None, None)])
    return corrected(t.geo_customers, turned.unionByName(moved))


@query("U4", """
SELECT id, co, CASE WHEN id % 10 = 3 THEN ABS(lon) ELSE lon END AS lon, lat FROM {geo_customers}""")
def replace_rows_by_id(t):
    g = t.geo_customers
    return replace_rows(g, g.where(F.col("id") % 10 == 3).withColumn("lon", F.abs("lon")))


@query("P23", "SELECT DISTINCT UPPER(com) AS com FROM {resolution} WHERE spot IS NOT NULL ORDER BY com")
def sorted_values(t):
    return t.resolution.where(F.col("spot").isNotNull()).select(F.upper("com").alias("com")).distinct().orderBy("com")


@query("P25 U2", """
SELECT 'capture' AS source, id, UPPER(obs) AS obs FROM {timeline} WHERE obs = 'BAGUAGE'
UNION ALL SELECT 'control', id, UPPER(obs) FROM {timeline} WHERE obs = 'CONTROLE'
UNION ALL SELECT 'recovery', id, UPPER(obs) FROM {timeline} WHERE obs = 'REPRISE'""")
def same_flow_per_table(t):
    parts = {"capture": "BAGUAGE", "control": "CONTROLE", "recovery": "REPRISE"}
    tables = {k: t.timeline.where(F.col("obs") == v).withColumn("source", F.lit(k)) for k, v in parts.items()}
    cleaned = each(tables, lambda d: d.select("source", "id", F.upper("obs").alias("obs")))
    return union_all(*cleaned.values())


@query("P27", """
SELECT id, CASE WHEN dpt IN ('44', '53') THEN 'Ouest' WHEN dpt IN ('41', '77', '89') THEN 'Centre'
  WHEN dpt IN ('42', '01', '51', '55') THEN 'Est' END AS nes_reg,
  CASE WHEN dpt IN ('44', '53') THEN 'Ouest' WHEN dpt IN ('01', '51') THEN 'Est' END AS report_reg
FROM (SELECT id, LPAD(CAST(id % 90 AS VARCHAR), 2, '0') AS dpt FROM {geo_customers}) x""")
def region_labels(t):
    dpt = F.lpad((F.col("id") % 90).cast("string"), 2, "0")
    return t.geo_customers.select("id", codes.labelled(dpt, codes.NESTING_REGIONS).alias("nes_reg"),
                                  codes.labelled(dpt, codes.REPORT_REGIONS).alias("report_reg"))


@query("P28 F15 F3", """
SELECT id, CASE WHEN sp IS NULL THEN NULL WHEN sp = 'AYTFER' THEN 'Aythya ferina' ELSE 'Aythya fuligula' END AS species,
  CAST(id AS VARCHAR) || ' / ' || COALESCE(sp, 'NA') || ' / ' || nes_reg AS label,
  MONTHNAME(datetime) || ' - ' || CAST(CAST(wgt_co AS BIGINT) AS VARCHAR) || ' obs.' AS head_fig
FROM {seasonal_orders}""")
def display_labels(t):
    return t.seasonal_orders.select(
        "id", codes.species_name("sp").alias("species"),
        nullsafe.glue(F.col("id").cast("string"), nullsafe.null_text("sp"), "nes_reg", sep=" / ").alias("label"),
        nullsafe.glue(time.month_name("datetime"), F.concat(nullsafe.number_text("wgt_co"), F.lit(" obs.")), sep=" - ")
        .alias("head_fig"))


@query("F2 F7", f"SELECT id, d, m, s, d2, m2, s2 FROM ({_DMS}) x")
def coordinate_parts(t):
    names = {"d": "long_deg", "m": "long_min", "s": "long_sec", "d2": "lat_deg", "m2": "lat_min", "s2": "lat_sec"}
    return t.dms_points.select("id", *[text.coordinate_part(c).alias(k) for k, c in names.items()])


@query("F8", f"""
SELECT id, ROUND(side * (d + m / 60 + s / 3600), 6) AS lon, ROUND(side * (d + m / 60 + COALESCE(s, 0) / 3600), 6) AS lon_0,
  ROUND(d2 + m2 / 60 + s2 / 3600, 6) AS lat FROM ({_DMS}) x""")
def dms_to_degrees(t):
    lon, lat = ("long_deg", "long_min", "long_sec"), ("lat_deg", "lat_min", "lat_sec")
    return t.dms_points.select(
        "id", F.round(text.dms_to_decimal(*lon), 6).alias("lon"),
        F.round(text.dms_to_decimal(*lon, missing_second_is_zero=True), 6).alias("lon_0"),
        F.round(text.dms_to_decimal(*lat), 6).alias("lat"))


@query("F9", f"""
SELECT id, CAST(side AS VARCHAR) || ':' || {_text_of('d')} || ':' || {_text_of('m')} || ':' || {_text_of('s')} AS raw_lon
FROM ({_DMS}) x""")
def raw_coordinate_text(t):
    return t.dms_points.select("id", text.raw_coordinate("long_deg", "long_min", "long_sec").alias("raw_lon"))


@query("F4 F5", """
SELECT id, REPLACE(UPPER(STRIP_ACCENTS(name)), 'Ł', 'L') AS name, UPPER(spot) AS spot FROM (SELECT id, spot, CASE id % 5
  WHEN 0 THEN 'Châlons-du-Maine' WHEN 1 THEN 'Trégunc' WHEN 2 THEN 'Nürnberg' WHEN 3 THEN 'São João' ELSE 'Łódź' END AS name
  FROM {resolution}) x""")
def plain_upper_names(t):
    k = F.col("id") % 5
    name = F.when(k == 0, "Châlons-du-Maine").when(k == 1, "Trégunc").when(k == 2, "Nürnberg").when(
        k == 3, "São João").otherwise("Łódź")
    return t.resolution.select("id", text.plain_upper(name).alias("name"), F.upper("spot").alias("spot"))


_COUNTRY_CELLS = ["0000", None, "Biélorussia", "Belgique", "Grece", "Netherlands", "Russia (west)", "Suisse", "SWT",
                  "Scotland", "UK", "Italia", "Poland", "New Switzerland"]


@query("F6 P16", """
SELECT id, CASE WHEN c IS NULL OR c LIKE '%0000%' THEN 'FRANCE' WHEN c LIKE '%BIELORUSSIA%' THEN 'BELARUS'
  WHEN c LIKE 'BELG%' THEN 'BELGIUM' WHEN c = 'GRECE' THEN 'GREECE' WHEN c LIKE 'NETHER%' THEN 'NETHERLANDS'
  WHEN c LIKE 'RUSSIA%' THEN 'RUSSIAN FEDERATION' WHEN REGEXP_MATCHES(c, '^(SWI|SUI|SWT)') THEN 'SWITZERLAND'
  WHEN c IN ('UK', 'OK', 'SCOTLAND') THEN 'U.K. OF GREAT BRITAIN AND NORTHERN IRELAND' WHEN c = 'ITALIA' THEN 'ITALY' ELSE c END AS co
FROM (SELECT id, UPPER(STRIP_ACCENTS(CASE id % 14 """
       + " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(_COUNTRY_CELLS))
       + " END)) AS c FROM {geo_customers}) x")
def country_names(t):
    k = F.col("id") % len(_COUNTRY_CELLS)
    cell = reduce(lambda acc, iv: acc.when(k == iv[0], F.lit(iv[1])), list(enumerate(_COUNTRY_CELLS))[1:],
                  F.when(k == 0, F.lit(_COUNTRY_CELLS[0])))
    return t.geo_customers.select("id", codes.country_name(cell).alias("co"))


@query("F10", """
SELECT id, CAST(CAST(ts AS DATE) AS TIMESTAMP) + CASE WHEN id % 4 = 0 THEN INTERVAL 12 HOUR
  ELSE TO_HOURS(CAST(HOUR(ts) AS INT)) + TO_MINUTES(CAST(MINUTE(ts) AS INT)) END AS datetime FROM {raw_obs}""")
def local_time_default_noon(t):
    clock = F.when(F.col("id") % 4 != 0, F.col("ts"))
    return t.raw_obs.select("id", time.local_instant("ts", clock, "UTC").cast("timestamp_ntz").alias("datetime"))


@query("F19", """
SELECT id, axis, proj FROM (SELECT id, lon AS East, lat AS North FROM {geo_customers}) x
UNPIVOT (proj FOR axis IN (East, North))""")
def wide_to_long(t):
    wide = t.geo_customers.select("id", F.col("lon").alias("East"), F.col("lat").alias("North"))
    return wide.unpivot(["id"], ["East", "North"], "axis", "proj")


@query("J7 P12", """
SELECT id, ring FROM {timeline} WHERE ring IN (SELECT ring FROM {timeline} WHERE obs = 'BAGUAGE')""")
def known_individuals(t):
    return keep_members(t.timeline, "ring", t.timeline.where(F.col("obs") == "BAGUAGE")).select("id", "ring")
