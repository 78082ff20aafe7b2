"""Hand corrections as data: a rule table instead of one block of code per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBERS = ("lon", "lat")
TEXTS = ("co", "dpt", "com", "spot")


def corrected(records: DataFrame, rules: DataFrame, numbers=NUMBERS, texts=TEXTS) -> DataFrame:
    """Apply rules ``(id, seq, field, op, value, text)`` to the records they name.

    ``op`` is set, add, negate or abs on one field, or swap, which exchanges the two numbers.
    The rules of a record run in the order of ``seq``, each on the outcome of the one before.
    """
    numbers = [c for c in numbers if c in records.columns]
    texts = [c for c, kind in records.dtypes if c in texts and kind == "string"]
    per_id = rules.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "field", "op", "value", "text"))).alias("_rules"))
    start = F.struct(*[F.col(c).cast("double").alias(c) for c in numbers],
                     *[F.col(c).cast("string").alias(c) for c in texts])
    other = dict(zip(numbers, reversed(numbers)))

    def number(acc: Column, rule: Column, c: str) -> Column:
        here = rule["field"] == c
        op = rule["op"]
        return (
            F.when(op == "swap", acc[other[c]])
            .when(here & (op == "set"), rule["value"])
            .when(here & (op == "add"), acc[c] + rule["value"])
            .when(here & (op == "negate"), -acc[c])
            .when(here & (op == "abs"), F.abs(acc[c]))
            .otherwise(acc[c])
            .alias(c)
        )

    def text(acc: Column, rule: Column, c: str) -> Column:
        return F.when((rule["field"] == c) & (rule["op"] == "set"), rule["text"]).otherwise(acc[c]).alias(c)

    def step(acc: Column, rule: Column) -> Column:
        return F.struct(*[number(acc, rule, c) for c in numbers], *[text(acc, rule, c) for c in texts])

    fixed = F.when(F.col("_rules").isNotNull(), F.aggregate("_rules", start, step))
    out = records.join(per_id, "id", "left").withColumn("_fixed", fixed)
    return out.select(*[
        F.when(F.col("_fixed").isNotNull(), F.col(f"_fixed.{c}")).otherwise(F.col(c)).alias(c)
        if c in numbers + texts else F.col(c) for c in records.columns])


def rules_for(ids: DataFrame, edits: list[tuple]) -> DataFrame:
    """Rules ``(field, op, value, text)`` for every id of another result."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("seq"), F.lit(field).alias("field"), F.lit(op).alias("op"),
                 F.lit(value).cast("double").alias("value"), F.lit(text).cast("string").alias("text"))
        for i, (field, op, value, text) in enumerate(edits, 1)])
    return ids.select("id").distinct().select("id", F.inline(rows))


def replace_rows(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``old`` whose key is not in ``new``, and all of ``new``."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
