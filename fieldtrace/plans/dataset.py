"""From raw field tables to one cleaned, located and time-consistent dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.functions import text
from fieldtrace.functions.codes import country_name
from fieldtrace.functions.nullsafe import is_in, null_text, round_half_even, to_number
from fieldtrace.functions.time import local_instant
from fieldtrace.operators.corrections import corrected
from fieldtrace.operators.joins import drop_members, keep_members, natural_join, union_all
from fieldtrace.operators.records import (
    attach_positions, consistent_pairs, mean_positions, merge_sources, reference_pairs, unlocated_places,
)
from fieldtrace.operators.ranks import row_numbers
from fieldtrace.operators.resolve import reconcile_coordinates, resolve_places
from fieldtrace.operators.spatial import nearest_polygon
from fieldtrace.operators.timeline import first_attributes, gate_timeline
from fieldtrace.sources.store import staged

# The two species and the ringing departments of the project.
SPECIES = ["AYTFER", "AYTFUL"]
DEPARTMENTS = ["44", "53", "01", "77", "89", "41", "42", "51", "55"]

_LON, _LAT = ("long_deg", "long_min", "long_sec"), ("lat_deg", "lat_min", "lat_sec")
_PLACE = ["co", "dpt", "com", "spot"]


def _located(raw: DataFrame, obs: Column, datetime: Column, *extra: Column) -> DataFrame:
    return raw.select(
        "id", obs.alias("obs"), datetime.alias("datetime"), F.col("bague").alias("ring"), F.col("espece").alias("sp"),
        text.dms_to_decimal(*_LON).alias("lon"), text.dms_to_decimal(*_LAT).alias("lat"),
        text.raw_coordinate(*_LON).alias("raw_lon"), text.raw_coordinate(*_LAT).alias("raw_lat"), *extra)


def _ringed(raw: DataFrame, species: list[str]) -> DataFrame:
    return raw.where(is_in("espece", species) & F.col("bague").isNotNull())


def _place() -> list[Column]:
    return [F.col(a).alias(b) for a, b in zip(("pays", "departement", "commune", "lieudit"), _PLACE)]


def clean_captures(raw: DataFrame, species=SPECIES, departments=DEPARTMENTS, zone: str = "Europe/Paris") -> DataFrame:
    kept = _ringed(raw, species).where(is_in("departement", departments))
    return _located(kept, text.observation_code("action"), local_instant("date", "heure", zone),
                    text.sex_code("sexe").alias("sex"), text.age_code("age").alias("age"), *_place(),
                    F.col("code_marque").alias("mark"), to_number("poids").alias("wgh"))


def clean_controls(raw: DataFrame, species=SPECIES, zone: str = "Europe/Paris") -> DataFrame:
    return _located(_ringed(raw, species), F.lit("CONTROLE"), local_instant("date", "heure", zone), *_place(),
                    F.col("code_marque").alias("mark"), to_number("poids").alias("wgh"))


def clean_positions(raw: DataFrame, species=SPECIES, zone: str = "Europe/Paris") -> DataFrame:
    kept = _ringed(raw, species).where(text.valid_dms(*_LON) & text.valid_dms(*_LAT))
    return _located(kept, F.lit("CONTROLE"), local_instant("date", "heure", zone))


def clean_recoveries(raw: DataFrame, species=SPECIES, zone: str = "Europe/Paris") -> DataFrame:
    noon = F.lit(None).cast("timestamp_ntz")
    return _located(_ringed(raw, species), F.lit("REPRISE"), local_instant("date", noon, zone), *_place(),
                    to_number("poids").alias("wgh"))


def consistent_records(raw: dict[str, DataFrame], duplicates: DataFrame | None = None,
                       zone: str = "Europe/Paris") -> dict[str, DataFrame]:
    """First captures, controls of known individuals with a fitting mark and a place, recoveries."""
    # parsed tables are written once; the steps below read them several times
    captured = staged(clean_captures(raw["t_capture"], zone=zone))
    first = captured.where(F.col("obs") == "BAGUAGE")
    if duplicates is not None:
        first = drop_members(first, "id", duplicates)
    controls = merge_sources([clean_controls(raw["t_controle"], zone=zone), captured.where(F.col("obs") == "CONTROLE")],
                             first, "ring", "datetime", "id")
    controls = staged(controls)
    controls = consistent_pairs(controls, reference_pairs(first))
    positions = mean_positions(clean_positions(raw["t_controle_coo"], zone=zone), ["ring", "datetime"], "id")
    controls = attach_positions(controls, positions, ["ring", "datetime"])
    recoveries = keep_members(clean_recoveries(raw["t_reprise"], zone=zone), "ring", first)
    return {"capture": first, "control": controls, "recovery": recoveries}


def stacked(records: dict[str, DataFrame]) -> DataFrame:
    """All records in one table with normalised country names."""
    return union_all(*[df.withColumn("co", country_name("co")) for df in records.values()])


def located_records(records: DataFrame, spots: DataFrame, communes: DataFrame, rules: DataFrame | None = None,
                    found: DataFrame | None = None) -> DataFrame:
    """Corrected places of all records, resolved against the gazetteers."""
    places = records.select("id", *_PLACE, "lon", "lat")
    usable = text.in_box("lon", "lat")  # longitude has the same bound as latitude
    places = places.withColumns({c: F.when(usable, F.col(c)) for c in ("lon", "lat")})
    if rules is not None:
        places = corrected(places, rules)
    places = places.withColumns({c: text.plain_upper(c) for c in ("co", "com", "spot")})
    resolved = resolve_places(places, spots, communes, found)
    # the locality replaces the commune; the locality itself stays as recorded
    return reconcile_coordinates(resolved).select("id", "lon", "lat", "co", "dpt", "com", "spot")


def outside_country(records: DataFrame, borders: DataFrame, poly: str) -> DataFrame:
    """Located records outside the polygons of their country: ``dist`` in whole km and a label, farthest first in a place.

    ``borders`` are polygon edges with the country ``co``; a record of a country without polygon is left out.  Positions
    are compared once per country, however many records they have.
    """
    spots = staged(records.where(text.in_box("lon", "lat")).select("id", "co", "com", "spot", "lon", "lat"))
    near = nearest_polygon(spots, borders, poly, ["co"]).select("co", "lon", "lat", round_half_even("dist_km").alias("dist"))
    # a position outside comes with its records; the nearest search has one row per position
    rows = spots.join(near.where(F.col("dist") > 0), ["co", "lon", "lat"])
    named = [null_text(c).alias(c) for c in ("co", "com", "spot")]
    return rows.select("id", *named, "dist", F.concat_ws(" / ", "id", *[null_text(c) for c in ("co", "com", "spot")]).alias("spot_full")).orderBy(
        "co", "com", "spot", F.col("dist").desc(), "id")


def without_position(records: DataFrame) -> DataFrame:
    """Ids of records at places of which no record has a position; the place key has no separator."""
    loc = F.concat("com", "spot").alias("loc")
    return keep_members(records.select("id", loc), "loc", unlocated_places(records).select(loc)).select("id")


def build_dataset(raw: dict[str, DataFrame], spots: DataFrame, communes: DataFrame, rules: DataFrame | None = None,
                  dropped: DataFrame | None = None, duplicates: DataFrame | None = None,
                  found: DataFrame | None = None, zone: str = "Europe/Paris") -> DataFrame:
    """The cleaned dataset: one row per event within the timeline of its individual."""
    records = staged(stacked(consistent_records(raw, duplicates, zone)))
    located = staged(located_records(records, spots, communes, rules, found))
    events = records.select("id", "obs", "datetime", "ring", "sp", "wgh")
    if dropped is not None:
        events = drop_members(events, "id", dropped)
    gated = staged(gate_timeline(events))
    attributes = records.where(F.col("obs") == "BAGUAGE").select("id", "sp", "sex", "age")
    full = natural_join(gated.drop("sp"), attributes, "left", expect=["id"])
    full = natural_join(full, located, "left", expect=["id"])
    full = first_attributes(full, ["sp", "sex"])
    numbered = row_numbers(full.withColumnRenamed("id", "record").withColumn("_copy", F.xxhash64("lon", "lat", "com")),
                           [], ["sp", "sex", "ring", "datetime", "record", "_copy"], "id")
    return numbered.select("id", "ring", "obs", "datetime", "sp", "sex", "age", "wgh", "lon", "lat", "co", "dpt", "com",
                           "spot", "nobs", "reprise")
