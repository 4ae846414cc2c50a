"""Ways to deal rows over partitions, and positions within them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirflow.durable import materialize


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def partition_of(key: Column | str, n: int) -> Column:
    """Partition of a whole-number key: its non-negative remainder; a null key goes to 0."""
    return F.coalesce(F.pmod(_c(key), F.lit(n)), F.lit(0)).cast("int")


def null_safe_hash(*keys: Column | str) -> Column:
    """Spark's hash of the keys; a single null key counts as 0."""
    cols = [_c(k) for k in keys]
    return F.when(cols[0].isNull(), F.lit(0)).otherwise(F.hash(cols[0])) if len(cols) == 1 else F.hash(*cols)


def hash_partition(df: DataFrame, key: Column | str, n: int) -> DataFrame:
    """Deal rows so that partition p holds exactly the keys with partition_of(key) = p."""
    return df.repartitionById(n, partition_of(key, n))


def range_partition(df: DataFrame, n: int, *keys: Column | str) -> DataFrame:
    """Deal rows by sampled ranges of the keys."""
    return df.repartitionByRange(n, *keys)


def round_robin(df: DataFrame, n: int) -> DataFrame:
    """Deal rows evenly, whatever their keys."""
    return df.repartition(n)


def partition_counts(df: DataFrame) -> DataFrame:
    """(partition_id, n_rows) of the partitions that hold rows."""
    return df.groupBy(F.spark_partition_id().alias("partition_id")).agg(F.count("*").alias("n_rows"))


def sort_within(df: DataFrame, key: Column | str, n: int, *order: Column | str) -> DataFrame:
    """Rows with ``partition_id`` and their ``position`` (from 1) in the order of their partition."""
    rows = hash_partition(df, key, n).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    return rows.select("*", F.shiftright(at, 33).cast("int").alias("partition_id"), (at.bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("position"))


def sort_positions(df: DataFrame, *order: Column | str, n: int | None = None) -> DataFrame:
    """Rows with their ``position`` (from 1) in the total order, without one task seeing all rows.

    Rows are dealt by sampled ranges and sorted in their partitions; sizes of the partitions, one row each,
    are summed up and added.  The sorted rows are written first, so ranges cannot shift between reads.
    """
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order).select("*", F.shiftright(at, 33).alias("__p"), (at.bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("__i"))
    rows = materialize(rows, "sorted")
    sizes = rows.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).alias("__before"))
    # One row per partition: n rows at most.
    return rows.join(F.broadcast(before), "__p").withColumn("position", F.col("__before") + F.col("__i")).drop("__p", "__i", "__before")
