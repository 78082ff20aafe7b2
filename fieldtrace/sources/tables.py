"""Named tables in, named tables out."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtrace.operators.ranks import row_numbers

NULL_TOKENS = ("", "NA")


def null_tokens_to_null(df: DataFrame, tokens: Iterable[str] = NULL_TOKENS) -> DataFrame:
    """Turn the text tokens that stand for a missing value into nulls."""
    tokens = list(tokens)
    return df.withColumns({
        f.name: F.when(~F.col(f"`{f.name}`").isin(tokens), F.col(f"`{f.name}`"))
        for f in df.schema.fields if isinstance(f.dataType, T.StringType)
    })


def read_text_tables(
    spark: SparkSession, paths: Mapping[str, str], columns: Mapping[str, list[str]], **csv_options
) -> dict[str, DataFrame]:
    """Read delimited tables with every column as text, missing tokens as nulls."""
    out = {}
    for name, path in paths.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns[name]])
        raw = spark.read.schema(schema).options(header=True, **csv_options).csv(path)
        out[name] = null_tokens_to_null(raw)
    return out


def with_provenance_id(df: DataFrame, table: str, order: list, id_col: str = "id") -> DataFrame:
    """Text key ``<row number>_<table>``, numbered along an explicit total order."""
    numbered = row_numbers(df, [], order, out="_row")
    return numbered.withColumn(
        id_col, F.concat(F.col("_row").cast("string"), F.lit("_"), F.lit(table))
    ).drop("_row")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Read a cleaned dataset or a polygon edge layer."""
    return spark.read.parquet(path)


def write_dataset(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    """Write a dataset; with ``partition_by`` one folder per group replaces a loop over groups.

    Nothing is shuffled: each task writes its own rows of every group, so a group that holds a
    large share of the rows is written by many tasks.
    """
    parts = list(partition_by)
    df.write.mode("overwrite").partitionBy(*parts).parquet(path)
