"""Approximate nearest neighbours by cross-polytope hashing.

A vector is turned by a pseudo-rotation (three rounds of random signs and a fast Hadamard transform) and
falls to the nearest signed axis; a cell of a table is one axis, or two axes of two rotations.  Vectors whose
lengths differ get one more coordinate that makes all equally long, which keeps the order of inner products.
A query probes its nearest cells in each table; those of two axes are enumerated best first, from the pairs
of ranks i and j with i * j within the number of probes.

The number of tables, the axes of a cell and the probes are calibrated at every size in the same way.
``TRIALS`` rows are searched by brute force in all points (one pass, each task keeps its best), which gives the
rank that the cell of each true neighbour has among the cells of its query.  For every scheme the fewest probes
that find ``RECALL`` of them are taken, and the scheme with the least cost (vectors shipped, products
computed; shares of cells from a sample of ``SAMPLE`` rows).  Candidates are ranked by their exact inner product.

Points and probing queries meet by cell.  Cells are cut into blocks of about ``BLOCK`` points times as many
queries, so a hot cell is many tasks; each block returns its best per query, and a ranking that is limited
before the shuffle merges them.  No candidate is dropped.

Defined cases: vectors that are null, empty, zero, or hold nulls or non-finite numbers take no part, nor
do those of another length than the most frequent one (the shortest of ties); equal rows count once; rows that
share an id are never each other's neighbours, and take one place with the best of their scores; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weirflow.durable import materialize, small_join

ROUNDS, SEED = 3, 3
#: Schemes to choose from: numbers of tables, and axes of a cell.
TABLES, AXES = (2, 4, 8), (1, 2)
SAMPLE, TRIALS, RECALL = 4096, 256, 0.96
BLOCK = 1024
#: Products that cost as much as shipping one vector; the most probes of a table that are weighed.
SHIP, PROBES = 100, 4096


def hadamard(x):
    """Rows of x times the normalized Hadamard matrix; the width is a power of two."""
    import numpy as np

    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


class Hasher:
    """Axes of unit vectors; the same for the same parameters everywhere."""

    def __init__(self, dim: int, longest: float, even: bool):
        self.dim, self.longest, self.even = dim, longest, even
        self.width = 1 << max(1, (dim if even else dim + 1) - 1).bit_length()

    def padded(self, x, query: bool):
        """Vectors as unit vectors of full width."""
        import numpy as np

        out = np.zeros((len(x), self.width))
        length = np.linalg.norm(x, axis=1)
        if self.even or query:
            out[:, : self.dim] = x / length[:, None]
        else:
            out[:, : self.dim] = x / self.longest
            out[:, self.dim] = np.sqrt(np.maximum(0, 1 - (length / self.longest) ** 2))
        return out

    def scores(self, x, table: int, axis: int):
        """Closeness to each signed axis (2 * width columns)."""
        import numpy as np

        rng = np.random.default_rng([SEED, table, axis])
        for _ in range(ROUNDS):
            x = hadamard(x * rng.choice([-1.0, 1.0], self.width))
        return np.concatenate([x, -x], axis=1)

    def cells(self, x, table: int, axes: int):
        """Cell of each (padded) point."""
        cell = table
        for a in range(axes):
            cell = cell * 2 * self.width + self.scores(x, table, a).argmax(axis=1)
        return cell

    def probes(self, x, table: int, axes: int, n: int):
        """The n nearest cells of each (padded) query, nearest first."""
        import numpy as np

        few = min(n, 2 * self.width)
        total, cell = np.zeros((len(x), 1)), np.full((len(x), 1), table)
        for a in range(axes):
            s = self.scores(x, table, a)
            near = np.argsort(-s, axis=1, kind="stable")[:, :few]
            # Sums of a pair at ranks i and j are no larger than those of the (i + 1) * (j + 1) pairs before it.
            i, j = np.divmod(np.arange(total.shape[1] * few), few)
            inside = (i + 1) * (j + 1) <= n if a else np.full(few, True)
            i, j = i[inside], j[inside]
            total = total[:, i] + np.take_along_axis(s, near, axis=1)[:, j]
            cell = cell[:, i] * 2 * self.width + near[:, j]
            order = np.argsort(-total, axis=1, kind="stable")[:, :n]
            total, cell = np.take_along_axis(total, order, axis=1), np.take_along_axis(cell, order, axis=1)
        return cell

    def ranks(self, queries, owner, points, table: int, axes: int):
        """Place of the cell of each (padded) point among the cells of its query, ``queries[owner]``, from 0."""
        import numpy as np

        s = [self.scores(queries, table, a) for a in range(axes)]
        own = [self.scores(points, table, a).argmax(axis=1) for a in range(axes)]
        if axes == 1:
            return (s[0][owner] > s[0][owner, own[0]][:, None]).sum(axis=1)
        total = s[0][owner, own[0]] + s[1][owner, own[1]]
        up, out = np.sort(s[1], axis=1), np.empty(len(owner), np.int64)
        for k in range(len(queries)):
            mine = np.flatnonzero(owner == k)
            out[mine] = up.shape[1] * len(up[k]) - np.searchsorted(up[k], total[mine][:, None] - s[0][k] + 1e-12, side="right").sum(axis=1)
        return out


def calibrate(hasher: Hasher, trials, owner, neighbours, sample, n_points: int, n_queries: int) -> tuple[int, int, int]:
    """(tables, axes, probes) of least cost that find RECALL of the neighbours; ``neighbours[i]`` is one of ``trials[owner[i]]``."""
    import numpy as np

    if not len(owner):
        return TABLES[0], 1, 1
    queries, near, points = hasher.padded(trials, True), hasher.padded(neighbours, False), hasher.padded(sample, False)
    found = []
    for axes in AXES:
        ranks = np.stack([hasher.ranks(queries, owner, near, t, axes) for t in range(max(TABLES))])
        for tables in TABLES:
            probes = int(np.quantile(ranks[:tables].min(axis=0), RECALL, method="higher")) + 1
            if axes > 1 and probes > PROBES:
                continue
            share = 0.0
            for t in range(tables):
                cells, counts = np.unique(hasher.cells(points, t, axes), return_counts=True)
                asked = hasher.probes(queries, t, axes, probes)
                at = np.minimum(np.searchsorted(cells, asked), len(cells) - 1)
                share += np.where(cells[at] == asked, counts[at], 0).sum() / len(queries) / len(points)
            cost = SHIP * tables * (n_points + probes * n_queries) + share * n_points * n_queries
            found.append((cost, tables, axes, probes))
    return min(found)[1:]


def _trial_best(trials, k: int):
    """A mapInArrow function over points (id, v): the k best of a task for each trial, as (trial, id, v, score)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        ids, x = trials.value
        held = None
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                s = x @ _vectors(part.column(1), x.shape[1]).T
                s[ids[:, None] == part.column(0).to_numpy()[None, :]] = -np.inf
                top = np.argpartition(-s, min(k, s.shape[1]) - 1, axis=1)[:, :k]
                trial, point = np.repeat(np.arange(len(ids)), top.shape[1]), top.reshape(-1)
                keep = s[trial, point] > -np.inf
                trial, point = trial[keep], point[keep]
                rows = pa.Table.from_arrays([pa.array(trial), part.column(0).take(pa.array(point)), part.column(1).take(pa.array(point)), pa.array(s[trial, point])], names=["trial", "id", "v", "score"])
                rows = rows if held is None else pa.concat_tables([held, rows])
                rows = rows.sort_by([("trial", "ascending"), ("score", "descending")])
                trial = rows["trial"].to_numpy()
                held = rows.filter(pa.array(np.arange(len(rows)) - np.searchsorted(trial, trial) < k)).combine_chunks()
        if held is not None:
            yield from held.to_batches()

    return run


def _vectors(column, dim: int):
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _deal(hasher: Hasher, tables: int, axes: int, probes: int | None):
    """Rows (cell, id, v): of points, or with ``probes`` of queries."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                x = hasher.padded(_vectors(batch.column(1), hasher.dim), probes is not None)
                for t in range(tables):
                    cells = hasher.cells(x, t, axes)[:, None] if probes is None else hasher.probes(x, t, axes, probes)
                    rows = pa.array(np.repeat(np.arange(len(batch)), cells.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(cells.reshape(-1).astype(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows)], names=["cell", "id", "v"])

    return run


def _best(dim: int, k: int):
    """An applyInArrow function: the k best points of a block for each of its queries."""

    def run(rows):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        sides = [rows.filter(pc.equal(rows["query"], flag)).combine_chunks() for flag in (False, True)]
        if not len(sides[0]) or not len(sides[1]):
            return none
        (pid, p), (qid, q) = [(t["id"].to_numpy(), _vectors(t["v"].combine_chunks() if t["v"].num_chunks != 1 else t["v"].chunk(0), dim)) for t in sides]
        found = [[], [], []]
        # Points in the order of their ids, so that rows that share an id count once for the k best.
        order = np.argsort(pid, kind="stable")
        pid, p = pid[order], p[order]
        firsts = np.flatnonzero(np.concatenate(([True], pid[1:] != pid[:-1])))
        for at in range(0, len(q), 512):
            a, ids = q[at : at + 512], qid[at : at + 512]
            s = a @ p.T
            s[ids[:, None] == pid[None, :]] = -np.inf
            each, n = s if len(firsts) == len(p) else np.maximum.reduceat(s, firsts, axis=1), len(firsts)
            least = np.partition(each, n - k, axis=1)[:, n - k] if n > k else np.full(len(a), -np.inf)
            # A margin, as the order is settled by the sums below.
            r, c = np.nonzero((s >= (least - 1e-9 * (1 + np.abs(least)))[:, None]) & (s > -np.inf)) if n > k else np.nonzero(s > -np.inf)
            exact = (a[r] * p[c]).sum(axis=1)
            order = np.lexsort((pid[c], -exact, r))
            r, c, exact = r[order], c[order], exact[order]
            if n < len(p):
                _, best = np.unique(np.stack([r, pid[c]]), axis=1, return_index=True)
                best.sort()
                r, c, exact = r[best], c[best], exact[best]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            keep = place < k
            for out, x in zip(found, (ids[r[keep]], pid[c[keep]], exact[keep]), strict=True):
                out.append(x)
        return pa.table({n: pa.array(np.concatenate(x)) for n, x in zip(("query_id", "vec_id", "score"), found, strict=True)})

    return run


def nearest(points: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): both inputs are (id, v) of arrays of one numeric type."""
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists("v", lambda e: e != 0)
    points, queries = points.filter(fine), queries.filter(fine)
    kind, schema = dict(points.dtypes)["v"], "query_id long, vec_id long, score double"
    common = points.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    spark = points.sparkSession
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = common.d
    points = materialize(points.filter(F.size("v") == dim).select("id", "v").dropDuplicates(), "points")
    queries = materialize(queries.filter(F.size("v") == dim).select("id", "v").dropDuplicates(), "queries")
    length = F.sqrt(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda s, e: s + e * e))
    span = points.agg(F.min(length).alias("lo"), F.max(length).alias("hi"), F.count("*").alias("n")).first()
    hasher = Hasher(dim, span.hi, span.hi - span.lo <= 1e-5 * span.hi)
    whole = lambda rows: _vectors(rows["v"].combine_chunks() if rows["v"].num_chunks != 1 else rows["v"].chunk(0), dim)
    few = points.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    sample = whole(few)
    trials = spark.sparkContext.broadcast((few["id"].to_numpy()[:TRIALS], sample[:TRIALS]))
    best = points.mapInArrow(_trial_best(trials, k), f"trial long, id long, v {kind}, score double")
    best = best.withColumn("place", F.row_number().over(W.partitionBy("trial").orderBy(F.desc("score"), "id"))).filter(F.col("place") <= k).select("trial", "v").toArrow()
    tables, axes, probes = calibrate(hasher, sample[:TRIALS], best["trial"].to_numpy(), whole(best), sample, span.n, queries.count())

    dealt = materialize(points.mapInArrow(_deal(hasher, tables, axes, None), f"cell long, id long, v {kind}"), "cells")
    asked = materialize(queries.mapInArrow(_deal(hasher, tables, axes, probes), f"cell long, id long, v {kind}"), "probes")
    parts = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("int")
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("np")).join(asked.groupBy("cell").agg(F.count("*").alias("nq")), "cell")
    sizes = materialize(sizes.select("cell", parts("np").alias("bp"), parts("nq").alias("bq")), "cell_sizes")

    def blocked(rows, query: bool):
        own, other = ("bq", "bp") if query else ("bp", "bq")
        mine = F.pmod(F.xxhash64("id", "v"), F.col(own)).cast("int")
        rows = small_join(rows, sizes, ["cell"], "inner").withColumn("mine", mine).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return rows.select("cell", F.col("theirs" if query else "mine").alias("p"), F.col("mine" if query else "theirs").alias("q"), F.lit(query).alias("query"), "id", "v")

    block = blocked(dealt, False).union(blocked(asked, True)).groupBy("cell", "p", "q")
    best = block.applyInArrow(_best(dim, k), schema).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    line = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_neighbours(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")).filter("id is not null")
    return nearest(rows, rows.filter("id % 20 = 0"))


QUERIES = {"op6_neighbours": op6_neighbours}
SQL: dict[str, str] = {}
