"""Closed-form cases of indexes, fetch plans, commits, sizes and names."""

import pytest
from pyspark.sql import functions as F

from weirflow import durable
from weirflow.durable import materialize, small_join
from weirflow.functions import naming, sizing
from weirflow.operators import partitioning, relational
from weirflow.plans import fetchplan, mapoutput, metrics
from weirflow.streaming import events

BLOCK = "map_id long, reduce_id int, length long"


def blocks(spark, lengths):
    return spark.createDataFrame([(m, r, n) for m, xs in enumerate(lengths) for r, n in enumerate(xs)], BLOCK)


def ranges(spark, *pairs):
    return spark.createDataFrame(pairs, "start_reduce int, end_reduce int")


def test_block_and_batch_lookup(spark):
    index = mapoutput.index(blocks(spark, [[3, 1, 2, 4]]))
    got = {(r.start_reduce, r.end_reduce): (r.offset, r.length) for r in mapoutput.block_ranges(index, ranges(spark, (3, 4), (1, 4), (0, 4))).collect()}
    assert got == {(3, 4): (6, 4), (1, 4): (3, 7), (0, 4): (0, 10)}


def test_lookup_over_maps(spark):
    rows = blocks(spark, [[3, 1, 2], [2, 2, 1], [2, 2, 1]])
    assert rows.filter("reduce_id between 1 and 2").agg(F.count("*"), F.sum("length")).first() == (6, 9)
    got = mapoutput.block_ranges(mapoutput.index(rows), ranges(spark, (1, 3))).collect()
    assert len(got) == 3 and sum(r.length for r in got) == 9


def test_lengths_and_offsets_round_trip(spark):
    rows = blocks(spark, [[10, 0, 20], [0, 0, 0]])
    index = mapoutput.index(rows)
    ends = index.groupBy("map_id").agg((F.max("reduce_id") + 1).cast("int").alias("reduce_id"), F.sum("length").alias("offset"))
    back = mapoutput.from_offsets(index.select("map_id", "reduce_id", "offset").unionByName(ends))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_first_valid_attempt_wins(spark):
    rows = [(0, 1, 0, 32, 30, [10, 0, 20]), (0, 1, 1, 32, 30, [10, 0, 20]), (0, 2, 0, 32, 29, [10, 0, 20]), (0, 2, 1, 24, 30, [10, 0, 20]), (0, 2, 2, 32, 35, [7, 10, 18]), (0, 3, 0, 32, 1, [1, 1, 1])]
    tries = spark.createDataFrame(rows, "shuffle_id int, map_id long, attempt int, index_bytes long, data_bytes long, lengths array<long>").withColumn("first_offset", F.lit(0))
    got = mapoutput.arbitrate(tries, mapoutput.valid_attempt(3)).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 0, 30), (0, 2, 2, 35)]


def test_runs_skip_empty_blocks(spark):
    rows = blocks(spark, [[3, 0, 2, 0], [0, 0, 0, 0], [0, 5, 5, 1]]).withColumn("reader", F.lit(0))
    got = sorted((r.map_id, r.start_reduce, r.end_reduce, r.bytes) for r in fetchplan.merge_runs(rows).collect())
    assert got == [(0, 0, 3, 5), (2, 1, 4, 11)]


def test_packing_keeps_the_tail(spark):
    rows = blocks(spark, [[40, 60, 10, 0, 200, 5, 5, 5]]).withColumn("address", F.lit("a"))
    got = [(r.req_id, r.n_blocks, r.bytes) for r in fetchplan.pack_requests(rows, 500, 2).orderBy("req_id").collect()]
    assert got == [(0, 2, 100), (1, 2, 210), (2, 2, 10), (3, 1, 5)]
    split = fetchplan.split_groups(rows, 3).groupBy("group_id").count().orderBy("group_id").collect()
    assert [tuple(r) for r in split] == [(0, 3), (1, 3), (2, 1)]


def test_waves(spark):
    rows = spark.createDataFrame([("r", i, b) for i, b in enumerate([900, 50, 50, 1, 99, 2])], "reader string, req_id int, bytes long")
    got = [r.wave for r in fetchplan.waves(rows, 100, 2).orderBy("req_id").collect()]
    assert got == [0, 1, 1, 2, 2, 3]


def test_plans_of_long_lists_and_null_addresses(spark):
    """One address with many blocks, a null one, and none."""
    rows = spark.range(200_000).select(F.when(F.col("id") >= 10, "a").alias("address"), F.col("id").alias("map_id"), F.lit(0).alias("reduce_id"), F.lit(10).cast("long").alias("length"))
    packed = fetchplan.pack_requests(rows, 5000, 64)
    got = {(r.address, r.n_blocks): r.n for r in packed.groupBy("address", "n_blocks").agg(F.count("*").alias("n")).collect()}
    assert got == {(None, 10): 1, ("a", 64): 199_990 // 64, ("a", 199_990 % 64): 1}
    waved = fetchplan.waves(packed, 1280, 100, "address")
    assert waved.count() == packed.count() and waved.agg(F.max("wave")).first()[0] == (199_990 // 64 + 1) // 2
    assert fetchplan.pack_requests(rows.limit(0), 5000, 64).count() == 0


def test_index_service(spark):
    served = mapoutput.IndexService(blocks(spark, [[3, 1, 2, 4], [1, 1, 1, 1], [5, 0, 0, 5]]))
    ask = lambda *maps: {(r.map_id, r.offset, r.length) for r in served.segments(ranges(spark, (1, 4)), list(maps) or None).collect()}
    assert ask() == {(0, 3, 7), (1, 1, 3), (2, 5, 5)} and ask(2) == {(2, 5, 5)}
    first = durable.folders(served.table)
    served.refresh(blocks(spark, [[3, 1, 2, 4], [7, 2, 2, 2]]).filter("map_id = 1"))
    assert ask() == {(0, 3, 7), (1, 7, 6), (2, 5, 5)} and not durable.folders(served.table) & first


def test_a_scope_leaves_its_result_only(spark):
    made = []
    with durable.scope(spark) as keep:
        for k in range(3):
            made.append(materialize(spark.range(10), f"t{k}"))
        keep(made[1].filter("id > 3"))
    there = lambda df: spark._jvm.org.apache.hadoop.fs.Path(next(iter(df.inputFiles()), "/none")).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(next(iter(df.inputFiles()), "/none")))
    assert made[1].count() == 10 and there(made[1])
    for gone in (made[0], made[2]):
        with pytest.raises(Exception):  # noqa: B017, PT011
            gone.count()
    with pytest.raises(ZeroDivisionError), durable.scope(spark) as keep:
        last = keep(materialize(spark.range(10), "t"))
        1 / 0  # noqa: B018
    with pytest.raises(Exception):  # noqa: B017, PT011
        last.count()


def test_an_aborted_write_leaves_nothing_to_read(spark, tmp_path):
    """Segments of a task that fails are not committed."""
    from weirflow.sources import segments

    rows = spark.range(100).select("id", F.when(F.col("id") == 57, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("v"))
    path = str(tmp_path / "segments")
    with pytest.raises(Exception, match="lost"):
        segments.write_segments(rows, "id", 4, path)
    assert not list((tmp_path / "segments").rglob("part-*")) if (tmp_path / "segments").exists() else True
    segments.write_segments(rows.filter("id < 50"), "id", 4, path)
    assert segments.read_segments(spark, path, 0, 4).count() == 50


def test_a_damaged_segment_is_an_error_not_a_result(spark, tmp_path):
    from weirflow.sources import segments

    path = segments.write_segments(spark.range(5000), "id", 2, str(tmp_path / "segments"))
    file = next(iter(sorted((tmp_path / "segments" / "reduce_id=1").glob("part-*"))))
    data = bytearray(file.read_bytes())
    for k in range(20, 60):
        data[k] ^= 0x5A
    file.write_bytes(bytes(data))
    for crc in file.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception):  # noqa: B017, PT011
        segments.read_segments(spark, path, 1, 2).agg(F.sum("id")).collect()
    assert segments.read_segments(spark, path, 0, 1).count() == 2500


def test_the_shared_folder_must_be_named_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        durable.shared_dir(Session)


def test_size_codec_is_within_a_tenth(spark):
    rows = spark.range(0, 100_000).withColumn("code", sizing.encode_size(F.col("id"))).withColumn("back", sizing.decode_size(F.col("code")))
    assert rows.filter("id >= 2 and not (back >= id - 1 and back <= 1.1 * id)").count() == 0
    assert [tuple(r) for r in rows.filter("id < 2").collect()] == [(0, 0, 0), (1, 1, 1)]


def test_spill_batches(spark):
    got = sizing.spill_batches(spark.createDataFrame([(0, 25_000), (1, 10_000), (2, 0)], "map_id long, n long")).orderBy("map_id", "batch").collect()
    assert [tuple(r) for r in got] == [(0, 0, 10_000, 0), (0, 1, 10_000, 10_000), (0, 2, 5_000, 20_000), (1, 0, 10_000, 0)]


def test_sample_points(spark):
    got = spark.range(1).select(sizing.sample_points(F.lit(21)).alias("p")).first().p
    assert got == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 15, 17, 19, 21]


def test_probe_rounds(spark):
    rows = spark.range(0, 20_000).select("id", sizing.probe_rounds(F.col("id"), F.lit(50)).alias("k")).collect()
    for r in rows:
        k = 1
        while 150 * k * (k + 1) // 2 <= r.id:
            k += 1
        assert r.k == k


def test_names(spark):
    rows = spark.createDataFrame([("shuffle_3_14_15", "30m", "application_17_0042"), ("bad", "x", "none"), (None, None, None)], "b string, s string, a string")
    got = rows.select(naming.parse_block(F.col("b")).alias("p"), naming.byte_size(F.col("s")).alias("n"), naming.numeric_app_id(F.col("a")).alias("i")).collect()
    assert (got[0].p.shuffle_id, got[0].p.map_id, got[0].p.reduce_id, got[0].n, got[0].i) == (3, 14, 15, 30 << 20, 170042)
    assert all(r.p is None and r.n is None and r.i is None for r in got[1:])


def test_materialized_tables_have_no_lineage(spark):
    rows = materialize(spark.range(100).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    plan = rows._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "parquet" in plan.lower() and rows.count() == 7


def test_small_join_is_the_same_either_way(spark, monkeypatch):
    left = spark.createDataFrame([(i % 3 if i % 5 else None, i) for i in range(50)], "k long, v long")
    small = materialize(spark.createDataFrame([(0, "a"), (1, "b"), (None, "n")], "k long, s string"), "small")
    got = [sorted(map(repr, small_join(left, small, ["k"], how, max_rows=n, salts=k).collect())) for how in ("left", "inner") for n, k in ((10, 16), (0, 16), (0, 1))]
    assert got[0] == got[1] == got[2] and got[3] == got[4] == got[5] and len(got[0]) == 50 and len(got[3]) < 50
    monkeypatch.setattr(durable, "BROADCAST_BYTES", 0)
    assert sorted(map(repr, small_join(left, small, ["k"]).collect())) == got[0]


def test_salted_and_range_joins(spark):
    left = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(300)], "k long, v long")
    right = spark.createDataFrame([(i, f"n{i}") for i in range(0, 200)], "k long, s string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert sorted(map(repr, relational.salted_join(left, right, "k", how, 4).collect())) == sorted(map(repr, left.join(right, "k", how).collect()))
    spans = spark.createDataFrame([(0, 10, "a"), (5, 30, "b"), (30, 30, "none"), (-7, 3, "c")], "s long, e long, n string")
    points = spark.range(-10, 40).withColumnRenamed("id", "at")
    got = sorted((r["at"], r.n) for r in relational.range_join(points, spans, "at", "s", "e", 4).collect())
    assert got == sorted((p, n) for p in range(-10, 40) for s, e, n in ((0, 10, "a"), (5, 30, "b"), (-7, 3, "c")) if s <= p < e)


def test_stream_gives_the_closed_windows(spark, sf_dir, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf_dir}/events.parquet", tmp_path / "in/events.parquet")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    query = events.stream_windows(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "state"), "closed")
    query.awaitTermination(120)
    batch = {tuple(r) for r in events.tumbling(spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    closed = {tuple(r) for r in spark.table("closed").collect()}
    assert closed and closed <= batch


def test_reads_cut_and_join_blocks(spark):
    """42 blocks of 15 KiB: a first read of 10 KiB, then 20 KiB each as 5 + 15, 15 + 5 and so on."""
    rows = spark.createDataFrame([(m, 0, 15 << 10) for m in range(42)], BLOCK)
    got = {}
    for r in fetchplan.pack_reads(rows, 10 << 10, 20 << 10).orderBy("read_id", "map_id").collect():
        got.setdefault(r.read_id, []).append((r.map_id, r.block_offset >> 10, r.length >> 10))
    assert got[0] == [(0, 0, 10)] and got[1] == [(0, 10, 5), (1, 0, 15)] and got[2] == [(2, 0, 15), (3, 0, 5)]
    assert sum(n for x in got.values() for _, _, n in x) == 42 * 15


def test_chunks(spark):
    got = sizing.chunks(spark.createDataFrame([(0, 0, 25), (0, 1, 0), (0, 2, 10)], BLOCK), 10).collect()
    assert [(r.reduce_id, r.chunk, r.chunk_offset, r.chunk_length, r.is_full) for r in got] == [(0, 0, 0, 10, True), (0, 1, 10, 10, True), (0, 2, 20, 5, False), (2, 0, 0, 10, True)]


def test_eviction_stops_at_the_target(spark):
    rows = spark.createDataFrame([("t", 1, 50), ("t", 2, 30), ("t", 3, 30), ("t", 4, 5)], "task string, partition_id int, est_bytes long")
    got = sizing.evict_largest(rows, F.lit(75), "task").collect()
    assert [(r.partition_id, r.freed_before) for r in sorted(got, key=lambda r: r.freed_before)] == [(1, 0), (2, 50)]


def test_extrapolation(spark):
    rows = spark.createDataFrame([("b", 1, 100), ("b", 2, 300), ("b", 4, 200)], "b string, n_updates long, bytes long")
    got = [(r.per_update, r.projected) for r in sizing.extrapolate(rows, "b").orderBy("n_updates").collect()]
    assert got == [(0.0, 100), (200.0, 700), (0.0, 200)]


def test_orphans_and_complete_reads(spark):
    out = spark.createDataFrame([(1, 1), (2, 1)], "shuffle_id int, map_id int")
    assert [r.shuffle_id for r in mapoutput.orphans(out, spark.createDataFrame([(2,)], "shuffle_id int")).collect()] == [1]
    read = spark.createDataFrame([(1, True, 100, 100), (1, True, 0, 0), (2, False, 100, 100), (3, True, 100, 111)], "reader int, done boolean, stated long, length long")
    assert sorted(map(tuple, mapoutput.read_complete(read).collect())) == [(1, True, True), (2, False, True), (3, True, False)]


def test_empty_blocks_are_refused(spark):
    fine = blocks(spark, [[1, 2]])
    assert fetchplan.require_sizes(fine).agg(F.sum("length")).first()[0] == 3
    with pytest.raises(Exception, match="block without bytes: map 0, reduce 1"):
        fetchplan.require_sizes(blocks(spark, [[1, 0]])).collect()


def test_observed_counts(spark):
    rows, seen = metrics.observed(spark.range(10), "test_observed", total=F.sum("id"))
    rows.repartition(3).collect()
    assert seen.get == {"records": 10, "total": 45}


def test_hashes_and_slack(spark):
    got = spark.createDataFrame([(None,), ("a",)], "k string").select(partitioning.null_safe_hash("k").alias("h"), F.hash("k").alias("s"), sizing.with_slack(F.lit(101)).alias("n")).collect()
    assert got[0].h == 0 and got[1].h == got[1].s and got[0].n == 112
