"""Stage tables: a shuffled result written once so later passes read the same rows.

Iterative operators and operators that read one ordering twice cut their lineage here.  The
files go to the folder the cluster names in ``spark.checkpoint.dir``, so a lost executor costs
a re-read and not a recomputation.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def stage_root(spark: SparkSession) -> str:
    """Shared folder for stage tables: ``spark.checkpoint.dir``, or the warehouse where none is set."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
            or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Have the file system delete what was written when the driver ends."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)


def staged(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the stage folder and return a scan of what was written."""
    spark = df.sparkSession
    path = f"{stage_root(spark)}/fieldtrace-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)
