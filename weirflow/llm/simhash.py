"""SimHash near-dedup with pigeonring filtering.

A fingerprint has 64 bits, cut into a ring of five segments.  If two fingerprints differ in at most
four bits, some segment starts a chain in which every prefix of k segments differs in at most
``floor(4 * k / 5)`` bits: none in the first, one in the first two, two in the first three, and so on
round the ring.  So the first segment and the second, up to one flipped bit, make a 26-bit join key:
each fingerprint is stored under five keys and probes with 69.  With a third segment in the key, which then has
39 bits, it probes with 1330.  Either finds all; the one with the fewer rows to join for the number of
fingerprints is taken (:func:`chain_for`).  The rest of the chain and then the whole distance are checked inside the join.

Equal fingerprints are one row.  Before pairs are looked for, each fingerprint is compared with the
smallest that shares a stored key; those links are contracted, and the join yields only pairs between
different components.  A cluster of near copies is therefore linked by stars, not by all its pairs, and
no link between components is lost.

Spark takes a table that is exploded for as large as its file, so 69 keys of each fingerprint may look small enough to be
broadcast; all joins of fingerprints therefore name their kind.

Defined cases: null and blank texts have fingerprint zero; a component without any doc_id has null;
of repeated rows one stays in the filtering form; an empty table gives an empty result; other columns
pass through (working columns start with ``__s``).  The plan is the same at every size: nothing is broadcast by this module.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from weirflow.durable import columns, materialize, scope
from weirflow.llm.components import components

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: (first bit, bits) of the segments; five, one more than the distance.
RING = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def fingerprint(text: str | None) -> int:
    """The signed 64-bit fingerprint of a text."""
    from itertools import accumulate, repeat

    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    at = [0, *accumulate(len(w) + 1 for w in words)]
    ends = [e - 1 for e in at[SHINGLE:]] if len(words) > SHINGLE else [len(line)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(line.__getitem__, map(slice, at[:n], ends)), repeat(SEED)), np.uint64, n)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view(np.int64)[0])


def _run(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        prints = pa.array([fingerprint(x.as_py()) for x in batch.column(0)], pa.int64())
        yield pa.RecordBatch.from_arrays([prints, *batch.columns[1:]], names=["__s_fp", *batch.schema.names[1:]])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``__s_fp`` and the columns in ``keep``."""
    rows = docs.select(F.col(text).alias("__s_text"), *[F.col(c) for c in keep])
    return rows.mapInArrow(_run, StructType([StructField("__s_fp", LongType()), *rows.schema.fields[1:]]))


def _segment(x: Column, i: int) -> Column:
    first, bits = RING[i % len(RING)]
    return F.shiftrightunsigned(x, first).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def flips(i: int, chain: int) -> list[int]:
    """What may differ in a key of ``chain`` segments from the i-th: bits of the key, within the budget of every prefix."""
    found = [0]
    for k in range(2, chain + 1):
        bits = RING[(i + k - 1) % len(RING)][1]
        found = [(m << 13) | sum(1 << b for b in some) for m in found for n in range(DISTANCE * k // len(RING) - m.bit_count() + 1) for some in combinations(range(bits), n)]
    return found


def _keys(x: Column, probing: bool, chain: int) -> Column:
    """Keys of a fingerprint: (number of the first segment, 13 bits for each), with all allowed flips if it probes."""
    out = []
    for i in range(len(RING)):
        key = F.lit(i).cast("long")
        for k in range(chain):
            key = F.shiftleft(key, 13).bitwiseOR(_segment(x, i + k).cast("long"))
        masks = F.array(*[F.lit(m).cast("long") for m in (flips(i, chain) if probing else [0])])
        out.append(F.transform(masks, key.bitwiseXOR))
    return F.explode(F.concat(*out))


def chain_for(n: int) -> int:
    """Segments in the key for n fingerprints: the fewest rows probed and met."""
    return min((2, 3), key=lambda chain: sum(len(flips(i, chain)) * (1 + n / (1 << sum(RING[(i + k) % len(RING)][1] for k in range(chain)))) for i in range(len(RING))))


def _mask(i: int, chain: int) -> int:
    m = 0
    for first, bits in (RING[(i + j) % len(RING)] for j in range(chain)):
        m |= ((1 << bits) - 1) << first
    return m - (1 << 64) if m >> 63 else m


def chained(diff: Column, key: Column, chain: int) -> Column:
    """Whether each prefix of the ring that starts in the key's segment stays within its budget."""
    start = F.shiftright(key, 13 * chain).cast("int")
    ok = F.bit_count(diff) <= DISTANCE
    for segments in range(chain + 1, len(RING)):
        masks = F.array(*[F.lit(_mask(i, segments)).cast("long") for i in range(len(RING))])
        ok = ok & (F.bit_count(diff.bitwiseAND(F.get(masks, start))) <= DISTANCE * segments // len(RING))
    return ok


def link(prints: DataFrame, chain: int | None = None) -> DataFrame:
    """(fp, root) for every fingerprint that has a link, from a written table of distinct ``fp``."""
    chain = chain or chain_for(prints.count())
    stored = prints.select("fp", _keys(F.col("fp"), False, chain).alias("key"))
    pivots = stored.groupBy("key").agg(F.min("fp").alias("pivot"), F.max("fp").alias("top")).filter("pivot < top").select("key", "pivot")
    stars = stored.join(pivots.hint("merge"), "key").filter("pivot < fp and bit_count(fp ^ pivot) <= 4")
    first = components(stars.select(F.col("fp").alias("a"), F.col("pivot").alias("b")))
    known = prints.join(first.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("c"))
    known = materialize(known, "known")
    index = known.select(F.col("fp").alias("x"), F.col("c").alias("cx"), _keys(F.col("fp"), False, chain).alias("key"))
    probes = known.select(F.col("fp").alias("y"), F.col("c").alias("cy"), _keys(F.col("fp"), True, chain).alias("ykey"))
    diff = F.col("x").bitwiseXOR(F.col("y"))
    near = index.join(probes.hint("merge"), (F.col("key") == F.col("ykey")) & (F.col("cx") < F.col("cy")) & chained(diff, F.col("key"), chain))
    # cx < cy sees each pair of components from either side, as both are stored and probed.
    second = components(near.select(F.col("cx").alias("a"), F.col("cy").alias("b")))
    both = materialize(known.join(second.withColumnRenamed("node", "c").hint("merge"), "c", "left").select("fp", F.coalesce("root", "c").alias("root")), "rooted")
    linked = both.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select("root")
    return both.join(linked.hint("merge"), "root", "left_semi").select("fp", "root")


def groups(rows: DataFrame, first: Column) -> DataFrame:
    """(fp, first) for fingerprints shared by rows or linked: the least ``first`` of the component."""
    with scope(rows.sparkSession) as keep:
        prints = materialize(rows.groupBy(F.col("__s_fp").alias("fp")).agg(F.min(first).alias("first"), F.count("*").alias("n")), "prints")
        roots = link(prints.select("fp"))
        both = prints.join(roots.hint("merge"), "fp", "left").filter("n > 1 or root is not null").withColumn("root", F.coalesce("root", "fp"))
        both = materialize(both, "grouped")
        least = both.groupBy("root").agg(F.min("first").alias("least"))
        return keep(materialize(both.join(least.hint("merge"), "root").select(F.col("fp").alias("__s_fp"), F.col("least").alias("first")), "groups"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id), one row per document."""
    rows = materialize(fingerprints(docs, keep=("doc_id",)), "fingerprints")
    by = rows.join(groups(rows, F.struct(F.col("doc_id").isNull(), F.col("doc_id"))).hint("merge"), "__s_fp", "left")
    return by.select("doc_id", F.col("__s_fp").alias("fp"), F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group: the one with the smallest doc_id.  Texts are written once and shuffled once."""
    whole = docs.select(F.col("text").alias("__s_text"), F.struct(*columns(docs)).alias("__s_row"), F.monotonically_increasing_id().alias("__s_uid"))
    rows = materialize(fingerprints(whole, "__s_text", ("__s_row", "__s_uid")), "with_fingerprints")
    slim = rows.select("__s_fp", "__s_uid", F.col("__s_row.doc_id").alias("id"))
    by = groups(slim, F.struct(F.col("id").isNull(), F.col("id"), F.col("__s_uid").alias("uid")))
    # The hint keeps the plan of large tables for small ones.
    joined = rows.join(by.hint("shuffle_hash"), "__s_fp", "left")
    return joined.filter("first is null or first.uid = __s_uid").select("__s_row.*")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash": op5_simhash}
SQL: dict[str, str] = {}
