"""Operators on keyed rows.

Nulls are one key like any other, in grouping and in cogroup; null values are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reduce_by_key(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """One row per key; partial aggregates run before the exchange."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def count_by_key(df: DataFrame, keys: list[str]) -> DataFrame:
    return reduce_by_key(df, keys, n=F.count("*"))


def group_by_key(df: DataFrame, key: str, value: str, out: str = "values") -> DataFrame:
    """All values of a key, sorted, nulls first.  A key's values must fit one row."""
    held = F.sort_array(F.collect_list(F.struct(F.col(value).alias("v"))))
    return df.groupBy(key).agg(held.alias(out)).withColumn(out, F.transform(out, lambda x: x["v"]))


#: Equal values of a key that are folded at once.
RUN = 4096


def combine_by_key(df: DataFrame, key: str, value: str, create: Callable[[Column], Column], merge_value: Callable[[Column, Column], Column], merge_combiners: Callable[[Column, Column], Column], out: str = "combined", pieces: int = 1024) -> DataFrame:
    """The combiner triple as column functions.

    Equal values of a key are counted before the exchange and folded in runs of at most ``RUN``; the runs of a key are
    dealt by content into up to ``pieces`` lists, each of which is folded to one combiner, and those are merged.  So no
    list holds a hot key, be its rows equal or different.  ``merge_combiners`` must not depend on order, as in any shuffle.
    """
    fold = lambda xs, first, step: F.aggregate(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), first(F.get(xs, 0)), step)
    counted = df.groupBy(F.col(key), F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    runs = counted.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / RUN))))
    more = F.when(F.col("__i") < F.floor((F.col("__n") - 1) / RUN), RUN - 1).otherwise((F.col("__n") - 1) % RUN).cast("int")
    dealt = runs.select(key, F.pmod(F.xxhash64("__v", "__i"), F.lit(pieces)).alias("__piece"), F.struct(F.col("__v").alias("v"), more.alias("more")).alias("__x"))
    lists = dealt.groupBy(key, "__piece").agg(F.collect_list("__x").alias("__xs"))
    again = lambda c, x: F.aggregate(F.array_repeat(x["v"], x["more"]), c, merge_value)
    part = fold(F.col("__xs"), lambda x: again(create(x["v"]), x), lambda c, x: again(merge_value(c, x["v"]), x))
    parts = lists.select(key, part.alias("__c")).groupBy(key).agg(F.collect_list("__c").alias("__cs"))
    return parts.select(key, fold(F.col("__cs"), lambda c: c, merge_combiners).alias(out))


def merge_partials(partials: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """Merge combiners that earlier runs or spills left behind: the second phase of an aggregate."""
    return reduce_by_key(partials, keys, **aggregates)


def cogroup(left: DataFrame, right: DataFrame, key: str, left_value: str, right_value: str) -> DataFrame:
    """(key, left_values, right_values); a side without the key has an empty list.  Null keys meet."""
    a = group_by_key(left, key, left_value, "left_values").withColumnRenamed(key, "__a")
    b = group_by_key(right, key, right_value, "right_values").withColumnRenamed(key, "__b")
    both = a.join(b, F.col("__a").eqNullSafe(F.col("__b")), "full")
    none = lambda c: F.coalesce(F.col(c), F.array().cast(both.schema[c].dataType))
    return both.select(F.coalesce("__a", "__b").alias(key), none("left_values").alias("left_values"), none("right_values").alias("right_values"))


def sort_by_key(df: DataFrame, *order: Column | str) -> DataFrame:
    """Total order by sampled ranges and a sort in each."""
    return df.orderBy(*order)
