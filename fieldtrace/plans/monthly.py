"""One resighting per individual and month, and the share of individuals that moved away."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.functions.geo import to_lambert
from fieldtrace.functions.nullsafe import round_half_even
from fieldtrace.functions.time import month_name, shifted_winter
from fieldtrace.operators.density import density_2d
from fieldtrace.operators.keyed import first_per_key

WINTER_MONTHS = (1, 11, 12)
MOVED_KM = 10.0


def monthly_records(rows: DataFrame, uid: str = "id") -> DataFrame:
    """The resighting of each individual, year and month that is nearest to the 15th."""
    dated = rows.withColumns({
        "year": F.year("datetime"), "month": F.month("datetime"), "_gap": F.abs(F.dayofmonth("datetime") - 15)})
    return first_per_key(dated, ["ring", "year", "month"], ["_gap", uid]).drop("_gap")


def migration_rates(rows: DataFrame, distance: str = "dist_km", beyond: float = MOVED_KM) -> DataFrame:
    """Percentage of individual winters with a record beyond a distance, per region and species."""
    cold = rows.where(F.month("datetime").isin(*WINTER_MONTHS))
    per_winter = cold.groupBy("nes_reg", "sp", "ring", shifted_winter("datetime").alias("winter")).agg(
        F.max(F.when(F.col(distance) > beyond, 1).otherwise(0)).alias("mig"))
    return per_winter.groupBy("nes_reg", "sp").agg(
        round_half_even(100.0 * F.sum("mig") / F.count(F.lit(1))).alias("rate"))


def month_headings(records: DataFrame) -> DataFrame:
    """Records of each region, species and month, and the heading of its map."""
    counts = records.groupBy("nes_reg", "sp", "month").agg(F.count(F.lit(1)).alias("n"), F.min("datetime").alias("_at"))
    return counts.select("nes_reg", "sp", "month", "n", F.concat(month_name("_at"), F.lit(" - "), F.col("n").cast("string"), F.lit(" obs.")).alias("head_fig"))


def month_densities(records: DataFrame, box: tuple[tuple[float, float], tuple[float, float]], points: int = 100) -> DataFrame:
    """Density of each region, species and month on a grid over a box of projected coordinates, relative to its largest cell."""
    x, y = to_lambert("lon", "lat")
    rows = records.select("nes_reg", "sp", "month", x.alias("x"), y.alias("y"))
    return density_2d(rows, ["nes_reg", "sp", "month"], "x", "y", box, points)
