"""Which writer and reader a shuffle gets, as column expressions over its properties.

Columns: map_side_combine, relocatable, compressed, concat_codec, old_protocol (boolean), num_partitions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SERIALIZED = 1 << 24
HIGHLY_COMPRESSED = 2000


def bypass(threshold: int = -1) -> Column:
    return ~F.col("map_side_combine") & (F.col("num_partitions") <= threshold)


def serialized(enabled: bool = True) -> Column:
    return F.lit(enabled) & F.col("relocatable") & ~F.col("map_side_combine") & (F.col("num_partitions") <= MAX_SERIALIZED)


def writer(threshold: int = -1, optimized: bool = True) -> Column:
    """bypass, else serialized, else general."""
    return F.when(bypass(threshold), "bypass").when(serialized(optimized), "serialized").otherwise("general")


def reader() -> Column:
    """Block sizes are only averages beyond so many partitions."""
    return F.when(F.col("num_partitions") > HIGHLY_COMPRESSED, "unknown_sizes").otherwise("known_sizes")


def batch_fetch() -> Column:
    """Whether contiguous blocks of a map may be asked for as one."""
    return F.col("relocatable") & (~F.col("compressed") | F.col("concat_codec")) & ~F.col("old_protocol")
