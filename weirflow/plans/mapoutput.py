"""Map outputs as tables: lengths of blocks, offset indexes, block ranges, validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirflow.durable import discard, materialize

def lengths(df: DataFrame, map_id: Column, reduce_id: Column, bytes_: Column, maps: int, reduces: int) -> DataFrame:
    """(map_id, reduce_id, length) for every map and reduce partition; empty blocks have length 0."""
    held = df.groupBy(map_id.cast("long").alias("map_id"), reduce_id.cast("int").alias("reduce_id")).agg(F.sum(bytes_).cast("long").alias("length"))
    grid = df.sparkSession.range(maps).select(F.col("id").alias("map_id"), F.explode(F.sequence(F.lit(0), F.lit(reduces - 1))).alias("reduce_id"))
    return grid.join(held, ["map_id", "reduce_id"], "left").select("map_id", "reduce_id", F.coalesce("length", F.lit(0)).alias("length"))


def index(blocks: DataFrame) -> DataFrame:
    """Add ``offset``, the sum of the lengths before a block in its map output."""
    before = W.partitionBy("map_id").orderBy("reduce_id").rowsBetween(W.unboundedPreceding, -1)
    return blocks.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def from_offsets(offsets: DataFrame) -> DataFrame:
    """Lengths back from (map_id, reduce_id, offset), whose last entry of a map is its end."""
    after = F.lead("offset").over(W.partitionBy("map_id").orderBy("reduce_id"))
    return offsets.withColumn("length", after - F.col("offset")).filter("length is not null").select("map_id", "reduce_id", "length")


def block_ranges(indexed: DataFrame, ranges: DataFrame) -> DataFrame:
    """File segment (map_id, start_reduce, end_reduce, offset, length) of each range [start, end) in each map.

    ``ranges`` holds a few rows per reader.  Both ends are looked up in the index, as a reader does.
    """
    ends = indexed.groupBy("map_id").agg((F.max("reduce_id") + 1).cast("int").alias("at"), F.sum("length").alias("offset"))
    edges = indexed.select("map_id", F.col("reduce_id").alias("at"), "offset").unionByName(ends)
    start = edges.select("map_id", F.col("at").alias("start_reduce"), "offset")
    end = edges.select(F.col("map_id").alias("m"), F.col("at").alias("end_reduce"), F.col("offset").alias("end_offset"))
    found = ranges.join(start, "start_reduce").join(end, (F.col("m") == F.col("map_id")) & (ranges["end_reduce"] == end["end_reduce"])).drop(end["end_reduce"])
    return found.select("map_id", "start_reduce", "end_reduce", "offset", (F.col("end_offset") - F.col("offset")).alias("length"))


def valid_attempt(reduces: int) -> Column:
    """Whether an attempt's index and data agree: entries, first offset, and sum of the lengths."""
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)
    return (F.col("index_bytes") == (reduces + 1) * 8) & (F.col("first_offset") == 0) & (total == F.col("data_bytes"))


def arbitrate(attempts: DataFrame, valid: Column) -> DataFrame:
    """The attempt whose output stays for each map: the first valid one; maps without any are left out."""
    return attempts.filter(valid).groupBy("shuffle_id", "map_id").agg(F.min(F.struct("attempt", "data_bytes")).alias("won")).select("shuffle_id", "map_id", "won.attempt", "won.data_bytes")


def orphans(outputs: DataFrame, registered: DataFrame) -> DataFrame:
    """Outputs of shuffles that are no longer registered, which retention may delete."""
    return outputs.join(registered, "shuffle_id", "left_anti")


def orphans_of_maps(outputs: DataFrame, lost: DataFrame) -> DataFrame:
    """Outputs of the map tasks in ``lost(shuffle_id, map_id)``, which a retry writes anew."""
    return outputs.join(lost.select("shuffle_id", "map_id").distinct(), ["shuffle_id", "map_id"], "left_semi")


def orphans_of_apps(outputs: DataFrame, live: DataFrame) -> DataFrame:
    """Outputs of applications that no longer run, data and indexes alike."""
    return outputs.join(live.select("app_id").distinct(), "app_id", "left_anti")


class IndexService:
    """Offset indexes written once and read by everyone.

    The table lies sorted by map in the shared folder, so a look-up of some maps opens the row groups that hold them;
    ``refresh`` replaces the entries of maps that ran again, and old tables go when nothing reads them.
    """

    def __init__(self, blocks: DataFrame):
        self.table = self._written(index(blocks))

    @staticmethod
    def _written(rows: DataFrame) -> DataFrame:
        return materialize(rows.repartitionByRange("map_id").sortWithinPartitions("map_id", "reduce_id"), "index")

    def segments(self, ranges: DataFrame, maps: list[int] | None = None) -> DataFrame:
        """:func:`block_ranges` of all maps, or of a few that a reader asks for."""
        rows = self.table if maps is None else self.table.filter(F.col("map_id").isin(maps))
        return block_ranges(rows, ranges)

    def refresh(self, blocks: DataFrame) -> None:
        """Take the lengths of maps that ran again."""
        kept = self.table.join(blocks.select("map_id").distinct(), "map_id", "left_anti")
        old, self.table = self.table, self._written(kept.unionByName(index(blocks)))
        discard(old)


def read_complete(read: DataFrame) -> DataFrame:
    """Per reader: whether all parts came (``parts_read = parts``) and none is over a tenth longer than stated."""
    return read.groupBy("reader").agg((F.sum(F.col("done").cast("int")) == F.count("*")).alias("all_read"), (~F.bool_or(F.col("stated") * 1.1 < F.col("length"))).alias("sizes_fit"))
