"""Reduce-major storage of exchanged rows: one folder per reduce partition.

Rows land in ``reduce_id=<n>`` folders through Spark's commit protocol.  A reader names a range of reduce
partitions and only those folders are opened (partition pruning); rows stream, no block is held whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.durable import new_path
from weirflow.operators.partitioning import partition_of


def write_segments(df: DataFrame, key: Column | str, partitions: int, path: str | None = None) -> str:
    """Exchange ``df`` by key and store it reduce-major; returns the path."""
    path = path or new_path(df.sparkSession, "segments")
    rows = df.withColumn("reduce_id", partition_of(key, partitions))
    rows.repartitionById(partitions, "reduce_id").write.partitionBy("reduce_id").mode("overwrite").parquet(path)
    return path


def read_segments(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Rows of the reduce partitions in [start, end)."""
    return spark.read.parquet(path).filter((F.col("reduce_id") >= start) & (F.col("reduce_id") < end))
