"""Data behind the grouped map layers: group key, colour key and colour code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtrace.functions.nullsafe import glue
from fieldtrace.operators.keyed import ROWS, attach_per_key
from fieldtrace.operators.ranks import appearance_codes


def layer_groups(rows: DataFrame, parts: list[str], colour: str, uid: str = "id") -> DataFrame:
    """Rows with the layer ``gp``, the colour key ``gp_col`` and its code in order of appearance."""
    keyed = rows.withColumns({"gp": glue(*parts, sep="~"), "gp_col": F.col(colour)})
    codes = appearance_codes(keyed, "gp_col", uid, "id_co")
    sizes = keyed.groupBy("gp_col").agg(F.count(F.lit(1)).alias(ROWS))
    return attach_per_key(keyed, codes.join(sizes, "gp_col"), ["gp_col"], "left")


def legend_rows(rows: DataFrame) -> DataFrame:
    return rows.select("gp_col", "id_co").distinct()
