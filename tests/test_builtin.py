"""Operators that Spark supplies: their plans, and their results when memory is short or keys are hot."""

from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from weirflow.operators import keyed, partitioning


@contextmanager
def settings(spark, **conf):
    conf = {k.replace("__", "."): v for k, v in conf.items()}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def rows(spark, n=20_000):
    return spark.range(n).select((F.col("id") % 997).alias("k"), F.col("id").alias("v"), (F.col("id") % 997).cast("string").alias("s"))


def test_sums_are_hashed_and_combined_first(spark):
    plan = executed(keyed.reduce_by_key(rows(spark), ["k"], v=F.sum("v")))
    assert "HashAggregate" in plan and "partial_sum" in plan and plan.index("partial_sum") > plan.index("Exchange")


def test_object_aggregate_falls_back_to_sorting(spark):
    lists = lambda: {r.k: r["values"] for r in keyed.group_by_key(rows(spark), "k", "v").collect()}
    want = lists()
    with settings(spark, spark__sql__objectHashAggregate__sortBased__fallbackThreshold="2"):
        assert lists() == want
    assert "ObjectHashAggregate" in executed(keyed.group_by_key(rows(spark), "k", "v"))


def test_aggregates_of_texts_are_sorted(spark):
    got = keyed.reduce_by_key(rows(spark), ["k"], s=F.max("s"))
    assert "SortAggregate" in executed(got) and all(r.s == str(r.k) for r in got.collect())


def test_small_partitions_are_read_together(spark):
    with settings(spark, spark__sql__adaptive__enabled="true", spark__sql__shuffle__partitions="50"):
        assert "AQEShuffleRead coalesced" in executed(keyed.reduce_by_key(rows(spark), ["k"], v=F.sum("v")))


def test_hot_partitions_of_a_join_are_split(spark):
    off = {"spark__sql__autoBroadcastJoinThreshold": "-1", "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1", "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "10k", "spark__sql__adaptive__advisoryPartitionSizeInBytes": "10k", "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "1.5", "spark__sql__adaptive__coalescePartitions__enabled": "false"}
    hot = spark.range(300_000).repartition(20).select(F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id") % 1000).alias("k"), "id")
    keys = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    with settings(spark, **off):
        both = hot.join(keys, "k")
        assert "skew=true" in executed(both.groupBy().count()) or "skewed" in executed(both) and both.count() == 300_000


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
def test_sort_merge_joins_with_null_keys(spark, how):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "d")], "k long, x string")
    b = spark.createDataFrame([(2, "p"), (3, "q"), (None, "r")], "k long, y string")
    want = {"inner": 2, "left": 4, "right": 4, "full": 6, "left_semi": 2, "left_anti": 2}[how]
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1"):
        got = a.join(b, "k", how)
        assert got.count() == want and "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_rows_and_bytes_of_an_exchange_are_counted(spark):
    plan = partitioning.hash_partition(rows(spark), "k", 7)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in text and plan.rdd.getNumPartitions() == 7
