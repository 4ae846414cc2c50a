"""Fetch plans: which blocks a reader asks for together, and when.

Where a plan depends on all blocks before, the rows of an address are sorted in their partition and folded in
one pass that holds a single state, however long its list.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _folded(rows: DataFrame, group: str, order: list[str], step: Callable, close: Callable, columns: list[str]) -> DataFrame:
    """Rows made by one ordered pass over each group.

    ``step(state, row)`` gives the next state (None before the first row) and the rows to emit, ``close(state)`` those
    left at a group's end; emitted rows lack the group, which is put first.
    """
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = [x.split()[0] for x in columns]
    at = [rows.columns.index(x) for x in (group, *order)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind, key, state, started = None, None, None, False
        for batch in batches:
            kind, out = batch.schema.types[at[0]], []
            for row in zip(*[batch.column(i).to_pylist() for i in at], strict=True):
                if not started or row[0] != key:
                    if started:
                        out += [(key, *x) for x in close(state)]
                    key, state, started = row[0], None, True
                state, made = step(state, row[1:])
                out += [(key, *x) for x in made]
            yield batch_of(out, kind, pa)
        if started:
            yield batch_of([(key, *x) for x in close(state)], kind, pa)

    def batch_of(out, kind, pa):
        types = [kind, *[{"int": pa.int32(), "long": pa.int64()}[x.split()[1]] for x in columns]]
        held = list(zip(*out, strict=True)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, types, strict=True)], names=[group, *names])

    dealt = rows.repartition(group).sortWithinPartitions(group, *order)
    return dealt.mapInArrow(run, ", ".join([f"`{group}` {fields[group]}", *columns]))


def require_sizes(blocks: DataFrame) -> DataFrame:
    """The blocks, which must all have a positive length; a reader may not ask for empty or negative ones."""
    bad = F.raise_error(F.concat(F.lit("block without bytes: map "), F.col("map_id").cast("string"), F.lit(", reduce "), F.col("reduce_id").cast("string")))
    return blocks.withColumn("length", F.when(F.col("length") > 0, F.col("length")).otherwise(bad.cast("long")))


def merge_runs(blocks: DataFrame, group: str = "reader") -> DataFrame:
    """Merge consecutive blocks of one map in a reader's list to [start_reduce, end_reduce).

    Empty blocks are dropped first and do not break a run.
    """
    line = W.partitionBy(group).orderBy("map_id", "reduce_id")
    rows = blocks.filter("length > 0").withColumn("starts", (~F.lag("map_id").over(line).eqNullSafe(F.col("map_id"))).cast("int"))
    rows = rows.withColumn("run_id", F.sum("starts").over(line))
    return rows.groupBy(group, "run_id", "map_id").agg(F.min("reduce_id").alias("start_reduce"), (F.max("reduce_id") + 1).alias("end_reduce"), F.sum("length").alias("bytes")).drop("run_id")


def pack_requests(blocks: DataFrame, max_bytes_in_flight: int, max_blocks: int) -> DataFrame:
    """(address, req_id, n_blocks, bytes): requests close at a fifth of the bytes in flight or at max_blocks.

    The last, partly filled request of an address is kept.
    """
    target = max(max_bytes_in_flight // 5, 1)

    def step(state, row):
        req, n, held = state or (0, 0, 0)
        n, held = n + 1, held + row[2]
        return ((req + 1, 0, 0), [(req, n, held)]) if held >= target or n >= max_blocks else ((req, n, held), [])

    rows = blocks.filter("length > 0").select("address", "map_id", "reduce_id", "length")
    return _folded(rows, "address", ["map_id", "reduce_id", "length"], step, lambda state: [state] if state[1] else [], ["req_id int", "n_blocks int", "bytes long"])


def split_groups(blocks: DataFrame, size: int) -> DataFrame:
    """Blocks of an address in groups of at most ``size``; the remainder is a group of its own."""
    line = W.partitionBy("address").orderBy("map_id", "reduce_id")
    return blocks.filter("length > 0").withColumn("group_id", F.floor((F.row_number().over(line) - 1) / size).cast("int"))


def waves(requests: DataFrame, max_bytes: int, max_requests: int, reader: str = "reader") -> DataFrame:
    """(reader, req_id, bytes, wave): requests in order; a wave is closed when the next would pass a limit.

    A wave always takes one request, however large.
    """

    def step(state, row):
        wave, n, held = state or (0, 0, 0)
        wave, n, held = (wave, n + 1, held + row[1]) if not n or n < max_requests and held + row[1] <= max_bytes else (wave + 1, 1, row[1])
        return (wave, n, held), [(*row, wave)]

    return _folded(requests.select(reader, "req_id", "bytes"), reader, ["req_id", "bytes"], step, lambda state: [], ["req_id int", "bytes long", "wave int"])


def pack_reads(blocks: DataFrame, first: int, limit: int) -> DataFrame:
    """(reduce_id, read_id, map_id, block_offset, length): a reduce partition's blocks as one stream of bytes.

    The first read asks for ``first`` bytes, later ones for ``limit``; a read holds the ends and beginnings
    of as many blocks as it reaches, and a large block spans several reads.
    """
    line = W.partitionBy("reduce_id").orderBy("map_id")
    rows = blocks.filter("length > 0").withColumn("end", F.sum("length").over(line)).withColumn("start", F.col("end") - F.col("length"))
    read = lambda x: F.when(x < first, F.lit(0)).otherwise(F.floor((x - first) / limit) + 1).cast("long")
    rows = rows.withColumn("read_id", F.explode(F.sequence(read(F.col("start")), read(F.col("end") - 1))))
    from_ = F.when(F.col("read_id") == 0, 0).otherwise(first + (F.col("read_id") - 1) * limit)
    to = F.when(F.col("read_id") == 0, first).otherwise(first + F.col("read_id") * limit)
    at = F.greatest(from_, F.col("start"))
    return rows.select("reduce_id", "read_id", "map_id", (at - F.col("start")).cast("long").alias("block_offset"), (F.least(to, F.col("end")) - at).cast("long").alias("length"))
