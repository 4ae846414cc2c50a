"""Durable exchange: results that outlive the executors that produced them.

Everything is written below the folder that the cluster names in ``spark.checkpoint.dir``, through
Spark's own writers and their commit protocol, so a lost executor costs at most the tasks it was
running.  ``localCheckpoint`` is never used.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors.

    ``spark.checkpoint.dir`` wins.  Where it is unset, local mode gets a temporary folder of its own; a cluster
    must name one, as any folder picked here might lie on one machine.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weirflow-"))
        return spark.sparkContext.getCheckpointDir().rstrip("/")
    raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")


#: Tables made inside each open :func:`scope`, innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def app_dir(spark: SparkSession, app_id: str | None = None) -> str:
    """The folder of an application's tables."""
    return f"{shared_dir(spark)}/weirflow/{app_id or spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the application's folder."""
    path = f"{app_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _scopes.get():
        made.append(path)
    return path


#: Ends the life of a query's shuffle files with the query.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: The column by whose values tables are written to folders of their own.
_by: ContextVar[tuple[str, ...]] = ContextVar("by", default=())


@contextmanager
def folders_by(spark: SparkSession, column: str, values: int) -> Iterator[None]:
    """Tables written inside have a folder for each of a column's few values, so that readers of one pass over the others.

    A task writes up to ``values`` files at once, without sorting.
    """
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, "0")
    spark.conf.set(key, values)
    token = _by.set((column,))
    try:
        yield
    finally:
        _by.reset(token)
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back, which cuts its lineage.

    What was shuffled for the table goes as soon as the table stands.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if by := partition_by or _by.get():
        writer = writer.partitionBy(*by)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared storage; those that are gone already are passed over."""
    conf = spark._jsc.hadoopConfiguration()
    for x in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(x)
        path.getFileSystem(conf).delete(path, True)


def folders(df: DataFrame) -> set[str]:
    """The tables of :func:`new_path` that a DataFrame reads."""
    return {m[0] for f in df.inputFiles() if (m := re.match(r".*/weirflow/[^/]+/[^/]+", f))}


def discard(*dfs: DataFrame) -> None:
    """Delete tables made by :func:`materialize` that nothing reads any more."""
    for df in dfs:
        delete(df.sparkSession, *folders(df))


def clean_app(spark: SparkSession, app_id: str | None = None) -> None:
    """Delete all tables of an application, by default of this one."""
    delete(spark, app_dir(spark, app_id))


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables made inside are deleted at the end, but for those that a DataFrame passed to the yielded function reads.

    After an error all go.
    """
    made: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.update(x.rsplit("/", 1)[1] for x in folders(df))
        return df

    token = _scopes.set((*_scopes.get(), made))
    try:
        yield keep
    except BaseException:
        kept.clear()
        raise
    finally:
        _scopes.reset(token)
        delete(spark, *[x for x in made if x.rsplit("/", 1)[1] not in kept])


#: Bytes on disk of a table that may be broadcast.
BROADCAST_BYTES = 64 << 20


def columns(df: DataFrame) -> list[Column]:
    """The columns of a table by quoted names, so that dots in them are part of the name."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def row_salt(df: DataFrame, salts: int) -> Column:
    """A salt from a row's content: the same whenever a lost task is run again, in whatever order rows come.

    Rows that are equal in all columns share a salt; columns that hold maps are left out.
    """
    fields = [c for c, f in zip(columns(df), df.schema.fields, strict=True) if not re.search("map<|variant", f.dataType.simpleString())]
    return F.pmod(F.xxhash64(*fields), F.lit(salts)).cast("int")


def small_join(left: DataFrame, small: DataFrame, on: list[str], how: str = "left", max_rows: int = 50_000, salts: int = 16) -> DataFrame:
    """Join a table to one of group results, whatever its size.

    ``small`` must be a written table: its rows are counted and its bytes known.  Up to ``max_rows`` rows and
    ``BROADCAST_BYTES`` it is broadcast.  Beyond that both sides are salted, so a group that holds a third of
    ``left`` is dealt over ``salts`` tasks; with one salt adaptive execution splits hot partitions instead.
    Keys compare null-safely; ``on`` columns come from ``left``.
    """
    right = small.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(on)], *[c for c in small.columns if c not in on])
    cond: Column = F.lit(True)
    for i, c in enumerate(on):
        cond = cond & left[c].eqNullSafe(right[f"__k{i}"])
    drop = [f"__k{i}" for i in range(len(on))]
    size = int(str(small._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= BROADCAST_BYTES and small.count() <= max_rows:
        return left.join(F.broadcast(right), cond, how).drop(*drop)
    if salts == 1:
        return left.join(right, cond, how).drop(*drop)
    left = left.withColumn("__weir_salt", row_salt(left, salts))
    right = right.withColumn("__weir_rsalt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    cond = F.col("__weir_salt") == F.col("__weir_rsalt")
    for i, c in enumerate(on):
        cond = cond & left[c].eqNullSafe(right[f"__k{i}"])
    return left.join(right, cond, how).drop(*drop, "__weir_salt", "__weir_rsalt")
