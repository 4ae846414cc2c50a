"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.llm import neighbours


def by_force(ids, x, q, k=20):
    out = {}
    for i in q:
        s = (x * x[list(ids).index(i)]).sum(axis=1)
        order = sorted((-s[j], ids[j]) for j in range(len(ids)) if ids[j] != i)[:k]
        out[i] = [(v, -s) for s, v in order]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return np.mean([len({v for v, _ in got.get(i, [])} & {v for v, _ in w}) / len(w) for i, w in want.items()])


def check(got, want, least=0.9):
    assert set(got) == set(want) and recall(got, want) >= least
    true = {i: dict(w) for i, w in want.items()}
    for i, rows in got.items():
        assert len(rows) == len(want[i])
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))
        assert all(abs(true[i][v] - s) < 1e-12 for v, s in rows if v in true[i])


def frame(spark, ids, x, kind="double"):
    return spark.createDataFrame([(int(i), [float(e) for e in v]) for i, v in zip(ids, x, strict=True)], f"id long, v array<{kind}>")


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    check(found(neighbours.op6_neighbours(spark, sf_dir).collect()), by_force(ids, x, [i for i in ids if i % 20 == 0]))


def test_blocks_and_unequal_lengths(spark, monkeypatch):
    """A hot cluster, lengths that differ, and blocks of few points."""
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(200, 12)) * rng.uniform(0.2, 4, (200, 1)), np.tile(rng.normal(size=12), (150, 1)) + rng.normal(0, 1e-3, (150, 12))])
    ids = list(range(len(x)))
    queries = [i for i in ids if i % 7 == 0]
    points = frame(spark, ids, x)
    check(found(neighbours.nearest(points, points.filter("id % 7 = 0")).collect()), by_force(ids, x, queries))


@pytest.mark.parametrize("axes", [1, 2])
def test_either_scheme(spark, monkeypatch, axes):
    monkeypatch.setattr(neighbours, "AXES", (axes,))
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    points = frame(spark, range(300), x)
    check(found(neighbours.nearest(points, points.filter("id % 10 = 0")).collect()), by_force(list(range(300)), x, list(range(0, 300, 10))))


def test_wide_vectors(spark):
    """768 dimensions, neighbours in clusters."""
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(40, 768)), 30, axis=0) + rng.normal(size=(1200, 768)) * 0.5
    points = frame(spark, range(1200), x)
    check(found(neighbours.nearest(points, points.filter("id % 20 = 0")).collect()), by_force(list(range(1200)), x, list(range(0, 1200, 20))))


def test_calibration_adapts_to_the_data():
    """Near neighbours need few probes, and many points longer cells."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(256, 64))
    near = np.repeat(centres, 20, axis=0) + rng.normal(size=(5120, 64)) * 0.05
    owner = np.repeat(np.arange(256), 20)
    h = neighbours.Hasher(64, 1.0, True)
    small = neighbours.calibrate(h, centres, owner, near, rng.normal(size=(4096, 64)), 2000, 100)
    large = neighbours.calibrate(h, centres, owner, near, rng.normal(size=(4096, 64)), 10**9, 5 * 10**7)
    assert small[2] < 40 and large[1] == 2
    far = neighbours.calibrate(h, centres, owner, rng.normal(size=(5120, 64)), rng.normal(size=(4096, 64)), 2000, 100)
    assert far[2] > small[2]


def test_ties_and_exact_copies(spark):
    x = np.array([[1.0, 0.0]] * 30 + [[0.0, 1.0]])
    got = found(neighbours.nearest(frame(spark, range(31), x), frame(spark, [0], x[:1])).collect())
    assert got[0] == [(i, 1.0) for i in range(1, 21)]


def test_odd_vectors(spark):
    rows = [(20, [1.0, 2.0]), (40, None), (60, []), (80, [0.0, 0.0]), (1, [float("nan"), 1.0]), (2, [float("inf"), 1.0]), (3, [None, 1.0]), (4, [1.0]), (5, [2.0, 1.0]), (20, [3.0, 1.0]), (6, [-1.0, -1.0])]
    points = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in neighbours.nearest(points, points.filter("id % 20 = 0")).collect()}
    assert set(got) <= {(20, 5), (20, 6)} and got[(20, 5)] in (4.0, 7.0)
    none = points.filter("id < 0")
    assert neighbours.nearest(none, none).count() == 0
    assert neighbours.nearest(points.filter("id = 20").limit(1), points.filter("id = 20").limit(1)).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(3).normal(size=(5, 64))
    y = neighbours.hadamard(x)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)) and np.allclose(neighbours.hadamard(y), x)


@pytest.mark.parametrize("axes", [1, 2])
def test_probes_and_ranks(axes):
    """Probes are the best cells by all sums, and ranks are their places."""
    h = neighbours.Hasher(16, 1.0, True)
    x = h.padded(np.random.default_rng(4).normal(size=(50, 16)), True)
    y = h.padded(np.random.default_rng(5).normal(size=(50, 16)), True)
    probes = h.probes(x, 3, axes, 60 if axes == 2 else 30)
    assert (probes[:, 0] == h.cells(x, 3, axes)).all()
    total = h.scores(x, 3, 0) if axes == 1 else (h.scores(x, 3, 0)[:, :, None] + h.scores(x, 3, 1)[:, None, :]).reshape(50, -1)
    order = np.argsort(-total, axis=1, kind="stable")
    assert (order[:, : probes.shape[1]] + 3 * total.shape[1] == probes).all()
    cells = h.cells(y, 3, axes) - 3 * total.shape[1]
    want = [int(np.flatnonzero(order[i] == cells[i])[0]) for i in range(50)]
    assert np.abs(h.ranks(x, np.arange(50), y, 3, axes) - want).max() == 0


def test_schema(spark, sf_dir):
    assert neighbours.op6_neighbours(spark, sf_dir).select(F.col("rank")).schema[0].dataType.simpleString() == "int"


def test_a_repeated_id_takes_one_place_of_a_block():
    import pyarrow as pa

    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 4))
    ids, v = np.concatenate([np.repeat(np.arange(40), 3), [100]]), np.concatenate([np.repeat(x, 3, axis=0), x[:1]])
    order = rng.permutation(120)
    ids[:120], v[:120] = ids[order], v[order]
    rows = pa.table({"query": [False] * 120 + [True], "id": ids, "v": v.tolist()})
    got = neighbours._best(4, 20)(rows)
    assert got["vec_id"].to_pylist() == np.argsort(-(x @ x[0]), kind="stable")[:20].tolist()


def test_repeated_ids_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(30, 4))
    points = spark.createDataFrame([(i % 30, (x[i % 30] * (1 + (i >= 60))).tolist()) for i in range(90)], "id long, v array<double>")
    got = neighbours.nearest(points, points.filter("id = 0"), 5).collect()
    assert len(got) == 5 and len({r.vec_id for r in got}) == 5 and sorted(r.rank for r in got) == [1, 2, 3, 4, 5]
