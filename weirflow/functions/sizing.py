"""Sizes: the one-byte codec, spill batches, probing reads, eviction, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def encode_size(size: Column) -> Column:
    """One byte: 0 for nothing, 1 for one, else the rounded-up logarithm to base 1.1, 255 at most."""
    log = F.ceil(F.log(size.cast("double")) / F.log(F.lit(1.1)))
    return F.when(size <= 0, 0).when(size <= 1, 1).otherwise(F.least(F.lit(255), log)).cast("int")


def decode_size(code: Column) -> Column:
    return F.when(code == 0, 0).otherwise(F.floor(F.pow(F.lit(1.1), code))).cast("long")


def with_slack(size: Column, tenths: int = 1) -> Column:
    """A buffer's size with so many tenths more, rounded up."""
    return F.ceil(size * (10 + tenths) / 10).cast("long")


def spill_batches(counts: DataFrame, size: int = 10_000) -> DataFrame:
    """(map_id, batch, n_records, first_record) from (map_id, n): a spill is written in batches."""
    rows = counts.filter("n > 0").withColumn("batch", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / size).cast("int"))))
    first = F.col("batch").cast("long") * size
    return rows.select("map_id", "batch", F.least(F.lit(size), F.col("n") - first).cast("long").alias("n_records"), first.alias("first_record"))


def chunks(blocks: DataFrame, size: int) -> DataFrame:
    """Blocks cut at a buffer's size: one row per chunk with its offset in the block, and whether it is full."""
    rows = blocks.filter("length > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / size).cast("int"))))
    at = F.col("chunk").cast("long") * size
    part = F.least(F.lit(size), F.col("length") - at).cast("long")
    return rows.withColumns({"chunk_offset": at, "chunk_length": part, "is_full": part == size})


def probe_rounds(length: Column, average: Column, slack: int = 100) -> Column:
    """Requests until a block of unknown size is read: the k-th asks for k * (average + slack) bytes, and a
    short answer ends it; so the least k whose first k requests ask for more than the length."""
    unit = average + slack
    guess = F.greatest(F.lit(1), F.floor((F.sqrt(1 + 8.0 * length / unit) - 1) / 2).cast("long") - 1)
    asked = lambda k: unit * k * (k + 1) / 2
    return F.array_min(F.filter(F.sequence(guess, guess + 4), lambda k: asked(k) > length))


def evict_largest(buffers: DataFrame, target: Column, group: str) -> DataFrame:
    """Buffers to move out, largest first, until ``target`` bytes are free."""
    line = W.partitionBy(group).orderBy(F.desc("est_bytes"), "partition_id")
    before = F.sum("est_bytes").over(line) - F.col("est_bytes")
    return buffers.withColumn("freed_before", before).filter(F.col("freed_before") < target)


def grant_watermark(execution_memory: Column, fraction: Column, task_cpus: Column, cores: Column, share: Column, reserved: int = 300 << 20) -> Column:
    """Grants below this many bytes count as low."""
    return F.floor((execution_memory - reserved) * fraction * task_cpus / cores * share).cast("long")


def sample_points(last: Column) -> Column:
    """Numbers of updates at which a buffer's size is measured: 1, then the rounded-up 1.1-fold, up to last."""
    steps = F.sequence(F.lit(1), F.ceil(F.log(F.greatest(last, F.lit(2)).cast("double")) / F.log(F.lit(1.1))).cast("int") + 12)
    grow = lambda s, _: F.when(F.element_at(s, -1) >= last, s).otherwise(F.array_append(s, F.greatest(F.element_at(s, -1) + 1, F.ceil(F.element_at(s, -1) * F.lit(1.1)).cast("long"))))
    return F.filter(F.aggregate(steps, F.array(F.lit(1).cast("long")), grow), lambda x: x <= last)


def extrapolate(samples: DataFrame, group: str) -> DataFrame:
    """Add bytes per update since the last sample (never negative) and the size projected to the next one."""
    line = W.partitionBy(group).orderBy("n_updates")
    rate = F.greatest(F.lit(0.0), (F.col("bytes") - F.lag("bytes").over(line)) / (F.col("n_updates") - F.lag("n_updates").over(line)))
    rows = samples.withColumn("per_update", F.coalesce(rate, F.lit(0.0)))
    return rows.withColumn("projected", F.floor(F.col("bytes") + F.col("per_update") * (F.coalesce(F.lead("n_updates").over(line), F.col("n_updates")) - F.col("n_updates"))).cast("long"))
