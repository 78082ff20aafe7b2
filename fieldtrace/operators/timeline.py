"""Event timelines of individuals: the span between first capture and recovery.

Every bound is the minimum of an ordered position, which an aggregate combines on the map side, so no
task has to sort the whole history of an individual.  The bounds come from three columns; the rows
themselves meet them once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.functions.nullsafe import order_struct
from fieldtrace.operators.keyed import attach_per_key

START, END = "BAGUAGE", "REPRISE"


def gate_timeline(events: DataFrame, key: str = "ring", kind: str = "obs", time: str = "datetime",
                  uid: str = "id") -> DataFrame:
    """Keep, per individual in order of time, what lies between the first start and the first end.

    Events before the first start go; after the first end only further end events stay.  An
    event without a kind makes everything from it on unknown, which drops it too.  Adds
    ``nobs``, the number of events kept, and ``reprise``, whether an end event is among them.
    """
    at = order_struct(time, uid)
    slim = events.select(key, kind, at.alias("_at"))
    is_end = F.col(kind) == END
    opened = slim.groupBy(key).agg(
        F.min(F.when(F.col(kind) == START, F.col("_at"))).alias("_start"),
        F.min(F.when(F.col(kind).isNull(), F.col("_at"))).alias("_unknown")).where(F.col("_start").isNotNull())
    begun = (F.col("_at") >= F.col("_start")) & (F.col("_unknown").isNull() | (F.col("_at") < F.col("_unknown")))
    ends = attach_per_key(slim.where(is_end), opened, [key], "inner").where(begun).groupBy(key).agg(F.min("_at").alias("_end"))
    bounds = attach_per_key(opened, ends, [key])
    # an event counts when it is an end event or lies before the first end event
    kept = begun & (is_end | F.col("_end").isNull() | (F.col("_at") < F.col("_end")))
    sizes = attach_per_key(slim, bounds, [key], "inner").where(kept).groupBy(key).agg(
        F.count(F.lit(1)).alias("nobs"), F.max(is_end).alias("reprise"))
    facts = attach_per_key(bounds, sizes, [key], "inner")
    return attach_per_key(events.withColumn("_at", at), facts, [key], "inner").where(kept).select(*events.columns, "nobs", "reprise")


def first_attributes(events: DataFrame, attributes: list[str], key: str = "ring", time: str = "datetime",
                     uid: str = "id") -> DataFrame:
    """Give every event of an individual the attributes of its first event, missing ones too."""
    firsts = events.groupBy(key).agg(
        F.min_by(F.struct(*attributes), order_struct(time, uid)).alias("_of_first"))
    joined = attach_per_key(events, firsts, [key], "inner")
    return joined.select(*[F.col(f"_of_first.{c}").alias(c) if c in attributes else F.col(c) for c in events.columns])


def reconciliation(captures: DataFrame, controls: DataFrame, recoveries: DataFrame, key: str = "ring") -> DataFrame:
    """How many captured records were seen again, recovered, both, either or neither."""
    flags = (
        captures.select(key, F.lit(1).alias("c"), F.lit(0).alias("s"), F.lit(0).alias("r"))
        .unionByName(controls.select(key, F.lit(0).alias("c"), F.lit(1).alias("s"), F.lit(0).alias("r")))
        .unionByName(recoveries.select(key, F.lit(0).alias("c"), F.lit(0).alias("s"), F.lit(1).alias("r")))
        .groupBy(key).agg(F.sum("c").alias("c"), F.max("s").alias("s"), F.max("r").alias("r"))
    )
    seen, got = F.col("s") == 1, F.col("r") == 1
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("c"))), F.lit(0)).cast("bigint")
    return flags.agg(
        F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("captured"), total(seen).alias("seen_again"),
        total(got).alias("recovered"), total(seen & got).alias("both"), total(seen | got).alias("either"),
        total(~seen & ~got).alias("neither"))
