"""From the cleaned dataset to wintering places, weights and fitted migration models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.functions import geo, time
from fieldtrace.functions.codes import NESTING_REGIONS, labelled
from fieldtrace.functions.nullsafe import strict_mean
from fieldtrace.operators import models, resample
from fieldtrace.operators.joins import natural_join
from fieldtrace.operators.keyed import ROWS, attach_per_key, first_per_key, with_group_values
from fieldtrace.operators.ranks import row_numbers
from fieldtrace.operators.spatial import label_near_site, nearest_polygon, polygon_measures
from fieldtrace.sources.store import staged

# A lake that counts as a country of its own, its radius, and the distances that
# separate staying, moving and outlying.
SITE, SITE_KM, SITE_NAME = (-1.66, 47.1), 7.0, "GRAND-LIEU"
MOVED_KM, OUTLYING_KM = 10.0, 2000.0


def nesting_records(dataset: DataFrame) -> DataFrame:
    """Captures of the nesting season with their region."""
    kept = dataset.where((F.col("obs") == "BAGUAGE") & time.in_days("datetime", time.NESTING_DAYS))
    return kept.select(
        "ring", F.col("datetime").alias("n_datetime"), "sp", time.default_text("sex").alias("sex"),
        time.default_text("age").alias("age"), F.col("lon").alias("n_lon"), F.col("lat").alias("n_lat"),
        F.col("dpt").alias("nes_dpt"), labelled("dpt", NESTING_REGIONS).alias("nes_reg"), "nobs")


def winter_candidates(dataset: DataFrame, nesting: DataFrame) -> DataFrame:
    """Resightings near midwinter of individuals seen more than once."""
    seen = dataset.where(F.col("obs") != "BAGUAGE").select("id", "obs", "ring", "datetime", "lon", "lat", "co").withColumns({
        "winter": time.winter("datetime"), "wintering": time.days_to_midwinter("datetime")}).where(
        F.col("wintering") < time.WINTER_HALF_WIDTH)
    attributes = nesting.where(F.col("nobs") > 1).select("ring", "sp", "sex", "age", "nes_dpt", "nes_reg").distinct()
    site = label_near_site("lon", "lat", "co", SITE, SITE_KM, SITE_NAME)
    return natural_join(seen, attributes, "inner", expect=["ring"]).withColumn("co", site)


def winter_records(candidates: DataFrame, nesting: DataFrame) -> DataFrame:
    """The record nearest to 24 December per individual and winter, seen from its nesting place."""
    chosen = first_per_key(candidates, ["ring", "winter"], ["wintering", "id", "nes_dpt", "age"])
    homes = nesting.select("ring", "n_datetime", "n_lon", "n_lat", "nes_reg")
    joined = natural_join(chosen, homes, "left", expect=["ring", "nes_reg"])
    return joined.withColumns({
        "angle_deg": geo.bearing("n_lon", "lon", "n_lat", "lat"),
        "angle_deg_base": geo.planar_bearing("n_lon", "lon", "n_lat", "lat"),
        "dist_pt_km": geo.distance_km("n_lon", "n_lat", "lon", "lat"),
        "age": time.age_class("age", "winter", "n_datetime")})


def weighted_winter_records(candidates: DataFrame, chosen: DataFrame) -> DataFrame:
    """Weights against and along the sightings per individual and winter in the country of the
    wintering place; a missing country is one of the countries."""
    spots = chosen.select("ring", "winter", "co", F.col("age").alias("class"))
    near = natural_join(candidates.drop("age"), spots, "inner", expect=["ring", "winter", "co"])
    counts = near.groupBy("ring", "winter", "co", "sp", "sex", "class").agg(F.count(F.lit(1)).alias("n"))
    effort = counts.groupBy("co").agg(F.avg("n").alias("nobs_win"))
    sizes = chosen.groupBy("co").agg(F.count(F.lit(1)).alias(ROWS))
    per = natural_join(sizes, effort, "left", expect=["co"])
    whole = per.agg(F.struct(F.sum(ROWS).alias("nb"), F.sum(F.col(ROWS) / F.col("nobs_win")).alias("inv"),
                             F.sum(F.col(ROWS) * F.col("nobs_win")).alias("dir")).alias("t")).scalar()
    weights = per.withColumns({"wgt_co": whole["nb"] / F.col("nobs_win") / whole["inv"],
                               "pres_co": whole["nb"] * F.col("nobs_win") / whole["dir"]})
    return attach_per_key(chosen, weights, ["co"], "left")


def water_allocation(rows: DataFrame, water: DataFrame, x: str, y: str, name: str, dist: str) -> DataFrame:
    """Nearest water body of each row's position and the distance to it."""
    near = nearest_polygon(rows.select(F.col(x).alias("lon"), F.col(y).alias("lat")), water, "wb_id")
    sizes = rows.groupBy(F.col(x).alias("lon"), F.col(y).alias("lat")).agg(F.count(F.lit(1)).alias(ROWS))
    per = natural_join(sizes, near, "inner", expect=["lon", "lat"]).select(
        F.col("lon").alias(x), F.col("lat").alias(y), ROWS, F.col("wb_id").alias(name), F.col("dist_km").alias(dist))
    return attach_per_key(rows, per, [x, y], "left")


def model_frames(winters: DataFrame, region: str = "Ouest", moved_km: float = MOVED_KM) -> dict[str, DataFrame]:
    """All records of a region, one per individual (nearest to its mean), and those that moved."""
    full = winters.where(F.col("nes_reg") == region).withColumn("mig", time.flag(F.col("dist_pt_km") > moved_km))
    rows = with_group_values(full, ["ring"], _mean=strict_mean("dist_pt_km"))
    rows = rows.withColumn("win_avg", F.round(F.abs(F.col("dist_pt_km") - F.col("_mean")), 9)).drop("_mean")
    simple = first_per_key(rows, ["ring"], ["win_avg", "id", "n_datetime"])
    moved = (F.col("mig") == 1) & (F.col("dist_pt_km") < OUTLYING_KM)
    return {"full": full, "simple": simple, "full_moved": full.where(moved), "simple_moved": simple.where(moved)}


def migration_models(frames: dict[str, DataFrame]) -> DataFrame:
    """Per species: share that moves, distance moved, and mean direction with its concentration."""
    share = models.group_fit(frames["simple"], "sp", "mig", "wgt_co", "binomial").select(
        "sp", F.col("fit").alias("mig_fit"), F.col("se_fit").alias("mig_se"))
    far = models.group_fit(frames["simple_moved"], "sp", "dist_pt_km", "wgt_co", "gamma").select(
        "sp", F.col("fit").alias("dist_fit"), F.col("se_fit").alias("dist_se"), "dispersion")
    way = models.von_mises_fit(frames["simple_moved"], "sp", "angle_deg", "wgt_co")
    return natural_join(natural_join(share, far, "left", expect=["sp"]), way, "left", expect=["sp"])


def water_choices(moved: DataFrame, water: DataFrame, parts: int = 7) -> DataFrame:
    """Centre and area weight of every water body: shares of the size classes that moved individuals are found on."""
    bodies = staged(polygon_measures(water, ["wb_id"]).withColumn("area", F.round("area", 9)).withColumnsRenamed({"x": "lon", "y": "lat"}))
    seen = water_allocation(moved.select("id", "lon", "lat"), water, "lon", "lat", "wb_id", "dist_alloc_km")
    occupied = staged(seen.join(bodies.select("wb_id", "area"), "wb_id").select("area"))
    bins = staged(models.occupied_bins(occupied, bodies, "area", parts))
    return models.habitat_weights(bins, bodies, "area").select("wb_id", "lon", "lat", "wgt_area")


def nesting_sites(moved: DataFrame) -> DataFrame:
    """Nesting places of the moved individuals, numbered by species and position."""
    places = moved.select("sp", "n_lon", "n_lat").distinct()
    return row_numbers(places, [], ["sp", "n_lon", "n_lat"], "site_id")


def simulated_migration(moved: DataFrame, water: DataFrame, replicates: int) -> DataFrame:
    """Directions that the moved individuals took, and those they would take if only water and distance counted.

    ``moved`` is ``simple_moved`` of ``model_frames``, ``water`` the edges of the water bodies.  Bodies in a size class that
    no individual uses have no weight.  Gives sp, ring, angle_deg, id (0 for what was observed, else the replicate),
    migration and wgt_co.
    """
    fit = staged(models.group_fit(moved, "sp", "dist_pt_km", "wgt_co", "gamma"))
    sites = staged(nesting_sites(moved))
    birds = moved.join(sites, ["sp", "n_lon", "n_lat"]).select("ring", "site_id")
    choices = staged(water_choices(moved, water).where(F.col("wgt_area") != 0))
    drawn = resample.site_draws(birds, sites, choices, fit, replicates)
    realized = moved.select("sp", "ring", geo.bearing("n_lon", "lon", "n_lat", "lat").alias("angle_deg"), "wgt_co")
    return resample.with_realized(drawn, realized, "sp", "ring", "angle_deg", "wgt_co")
