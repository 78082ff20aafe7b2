"""Consistency of individual records: duplicates, marks, sources and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.functions.nullsafe import strict_mean
from fieldtrace.operators.joins import keep_members, natural_join, union_all
from fieldtrace.operators.keyed import ROWS, attach_per_key, add_count, first_per_key


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def conflicting_attributes(df: DataFrame, key: str, attribute: str) -> DataFrame:
    """Individuals with more than one value of an attribute; a missing value counts as one."""
    values = df.select(key, attribute).distinct()
    return values.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def merge_sources(sources: list[DataFrame], known: DataFrame, key: str, time: str, order: str) -> DataFrame:
    """Stack sources, keep known individuals, and keep the first record per individual and time.

    Earlier sources win; within a source ``order`` decides.
    """
    ranked = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    stacked = keep_members(union_all(*ranked), key, known)
    return first_per_key(stacked, [key, time], ["_source", order]).drop("_source")


def reference_pairs(captures: DataFrame, key: str = "ring", mark: str = "mark") -> DataFrame:
    """Known pairs of individual and mark, from the first captures."""
    return captures.where(F.col(mark).isNotNull()).select(key, mark)


def consistent_pairs(controls: DataFrame, pairs: DataFrame, key: str = "ring", mark: str = "mark") -> DataFrame:
    """Controls whose mark belongs to the individual, or that state no mark."""
    known = pairs.select(key, mark).distinct().withColumn("_hit", F.lit(True))
    flagged = attach_per_key(controls, known, [key, mark])
    keep = F.col("_hit").isNotNull() | F.col(mark).isNull() | F.contains(F.col(mark), F.lit("MARQUE"))
    return flagged.where(keep).drop("_hit")


def pair_conflicts(controls: DataFrame, pairs: DataFrame, key: str = "ring", mark: str = "mark",
                   uid: str = "id") -> DataFrame:
    """Controls without a known pair, the number of such controls of the individual, and each of
    its reference marks (null where it has none)."""
    known = pairs.select(key, mark).distinct()
    strange = attach_per_key(controls, known.withColumn("_hit", F.lit(True)), [key, mark]).where(F.col("_hit").isNull()).drop("_hit")
    counted = add_count(strange, [key], "n")
    return natural_join(counted, known.withColumnRenamed(mark, "reference"), "left", on=[key])


def mean_positions(positions: DataFrame, keys: list[str], order: str, numbers=("lon", "lat"), raws=()) -> DataFrame:
    """One position per key: the mean of the coordinates and the first raw texts."""
    return positions.groupBy(*keys).agg(
        *[strict_mean(c).alias(c) for c in numbers], *[F.min_by(c, order).alias(c) for c in raws])


def attach_positions(controls: DataFrame, positions: DataFrame, keys: list[str]) -> DataFrame:
    """Coordinates from the position table, else the record's own; a record without either stays
    only when commune and locality are named.

    A missing coordinate in the position table is kept as it is, as the table has the record.
    """
    p = positions.select(*keys, F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), F.lit(True).alias("_found"))
    joined = natural_join(controls, p, "left", on=keys)
    found = F.col("_found").isNotNull()
    own = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    named = F.col("com").isNotNull() & F.col("spot").isNotNull()
    return joined.where(found | own | named).withColumns({
        "lon": F.when(found, F.col("_lon")).otherwise(F.col("lon")),
        "lat": F.when(found, F.col("_lat")).otherwise(F.col("lat")),
    }).drop("_lon", "_lat", "_found")


def unlocated_places(records: DataFrame, keys=("co", "com", "spot")) -> DataFrame:
    """Places none of whose records has a position, with their record count."""
    located = F.when(F.col("lon").isNull() | F.col("lat").isNull(), 0).otherwise(1)
    states = records.withColumn("pos", located).groupBy(*keys, "pos").agg(F.count(F.lit(1)).alias("n"))
    return states.groupBy(*keys).agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).where(F.col("pos") == 0)
