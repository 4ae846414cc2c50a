"""The language model: base columns by hand, proper probabilities, better than counting on held-out texts."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from weirflow.llm import language_model as lm


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % 5 == 1


def base_by_hand(rows):
    counts = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, x in rows:
        ts = tokens(x)
        out.append((i, held(i), len(ts), sum(counts[t] > 0 for t in ts), n, sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)))
    return out


def check(got, rows):
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(base_by_hand(rows), key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
        assert math.isfinite(a[6]) and a[6] < 0 and a[7] == pytest.approx(10 ** (-a[6] / a[2]))


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = lm.op8_language_model(spark, sf_dir).collect()
    check(got, rows)
    sums = lambda flag: (sum(r.score for r in got if r.held_out == flag), sum(r.base_score for r in got if r.held_out == flag))
    for flag in (True, False):
        assert sums(flag)[0] > sums(flag)[1]


def corpus(n=60):
    return [(i, f"the cat {i % 7} sat on the Mat {'x' * (i % 4)}") for i in range(n)]


@pytest.mark.parametrize(("head", "pairs"), [(400_000, 1_000_000), (400_000, 0), (5, 3), (0, 0)])
def test_small_heads_and_odd_rows(spark, monkeypatch, head, pairs):
    """Heads save work only; nulls, repeats and long texts."""
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "PAIRS", pairs)
    rows = [*corpus(), (None, "the dog"), (None, "the dog"), (5, None), (6, ""), (7, "cat " * 30_000), (8, "ÄÖ the ÄÖ"), (6, "a\x0bb\x1cc\x85d")]
    got = lm.score_documents(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")).collect()
    check(got, rows)
    scores = sorted((str(r.doc_id), r.n_tokens, r.score) for r in got)
    for (*a, x), (*b, y) in zip(scores, seen.setdefault("scores", scores), strict=True):
        # Another head draws other random numbers.
        assert a == b and (x == pytest.approx(y, rel=1e-9) if head > 5 else abs(x - y) < 0.25 * a[1])


seen: dict = {}


def test_tokens_of_pieces(monkeypatch):
    """Pieces and cuts of long texts change no token."""
    import pyarrow as pa

    texts = ["", None, "One two  THREE", " \n", "a", "ß é\tx " * 50, "long" * 40 + " " + "w " * 100, "", " lead", "trail "]
    words = {}

    def read(column):
        out = [(int(r), int(u), int(w)) for piece in lm.Reader(column) for r, u, w in zip(*piece, strict=True)]
        want = [(i, t) for i, x in enumerate(texts) for t in tokens(x)]
        assert [r for r, _, _ in out] == [i for i, _ in want]
        for (_, _, w), (_, t) in zip(out, want, strict=True):
            assert words.setdefault(t, w) == w
        last = None
        for k, (r, u, w) in enumerate(out):
            assert u == (lm.START if k == 0 or out[k - 1][0] != r else last)
            last = w
        return out

    whole = read(pa.array(texts))
    assert len(set(words.values())) == len(words) and words[b"\n"] == lm.END
    for size in (1, 7, 64):
        monkeypatch.setattr(lm, "PIECE", size)
        assert read(pa.array(texts)) == whole and read(pa.array(["other", *texts]).slice(1)) == whole


def test_pair_hash_is_that_of_spark(spark):
    rng = np.random.default_rng(1)
    u, w = rng.integers(-(1 << 63), 1 << 63, 50), rng.integers(-(1 << 63), 1 << 63, 50)
    rows = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(u, w, strict=True))], "i int, u long, w long").selectExpr("i", "xxhash64(u, w) as k").collect()
    assert [r.k for r in sorted(rows)] == lm.pair_hash(u, w).tolist()


def test_scores_by_brute_force(spark):
    """Predictions by plain look-ups sum to one in every context and give the scores."""
    import pyarrow as pa

    rows = [*corpus(), (200, "the dog sat on the cat"), (201, "never seen words the cat"), (202, "cat the the mat")]
    rows += [(i, f"{'abcde'[i % 5]} {'vwxyz'[i % 3]} end") for i in range(300, 340)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.Model(docs)
    words, pairs = {r.w: r for r in model.words.collect()}, {r.k: r for r in model.pairs.collect()}
    texts = [[(int(u), int(w)) for _, u, w in zip(*next(iter(lm.Reader(pa.array([x])))), strict=True)] for _, x in rows]
    seen_pairs = Counter(p for (i, _), t in zip(rows, texts, strict=True) if not held(i) for p in t)

    def probability(u, w):
        k = int(lm.pair_hash(np.array([u]), np.array([w]))[0])
        if seen_pairs[u, w] > 1:
            assert pairs[k].c == seen_pairs[u, w]
            return 10 ** pairs[k].lp
        back = np.mean([(words[u][f"b{s}"] if u in words else 1) * (words[w][f"p{s}"] if w in words else model.unseen[s - 1]) for s in model.sweeps])
        return back + (seen_pairs[u, w] and (1 - model.discount) / (lm.STRENGTH + words[u].c))

    vocabulary = [w for w in words if w != lm.START]
    for u in [lm.START, 12345, *[w for w in vocabulary if w != lm.END]]:
        assert sum(probability(u, w) for w in vocabulary) + probability(u, 67890) == pytest.approx(1, abs=1e-9)
    got = {r.doc_id: r.score for r in lm.score_documents(docs).collect()}
    for (i, _), t in zip(rows, texts, strict=True):
        assert got[i] == pytest.approx(sum(math.log10(probability(u, w)) for u, w in t), rel=1e-9)


def restaurant(rng, customers, prior, discount):
    """Tables of dishes, customer by customer, from all customers' tables."""
    tables = {w: [1] for w in customers}
    for w, n in customers.items():
        for _ in range(n - 1):
            total = sum(map(len, tables.values()))
            weights = [max(0, t - discount) for t in tables[w]] + [(lm.STRENGTH + discount * total) * prior[w]]
            at = rng.choice(len(weights), p=np.array(weights) / sum(weights))
            if at == len(tables[w]):
                tables[w].append(1)
            else:
                tables[w][at] += 1
    return {w: len(t) for w, t in tables.items()}


def test_seating_against_single_customers():
    rng = np.random.default_rng(7)
    customers, prior = {0: 6, 1: 3, 2: 1, 3: 10}, {0: 0.4, 1: 0.1, 2: 0.3, 3: 0.2}
    slow = np.mean([[restaurant(rng, customers, prior, 0.5)[w] for w in range(4)] for _ in range(3000)], axis=0)
    counts, p, t = np.array(list(customers.values())), np.array(list(prior.values())), np.ones(4, np.int64)
    fast = []
    for _ in range(3000):
        t = lm.seat(counts, p, 0.5, lm.STRENGTH, t.sum() - t, rng)
        fast.append(t)
    # Blocked seating sees the other dishes' final tables, single customers those so far: close, not equal.
    assert np.abs(np.mean(fast, axis=0) - slow).max() < 0.6


def test_seating():
    rng = np.random.default_rng(1)
    counts = np.array([0, 1, 2, 5, 1000, 1, 100_000])
    t = lm.seat(counts, np.full(7, 1 / 7), 0.5, 1.0, np.zeros(7, np.int64), rng)
    assert t[0] == 0 and t[1] == t[5] == 1 and (t <= counts).all() and (t[counts > 0] >= 1).all() and t[6] > t[2]
    alone = lm.seat(np.full(20_000, 3), np.full(20_000, 1.0), 0.0, 1.0, np.zeros(20_000, np.int64), rng)
    # With discount 0 and strength 1: new tables with chances 1/2 and 1/3.
    assert abs(alone.mean() - (1 + 1 / 2 + 1 / 3)) < 0.03


def test_empty_and_untrained(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_documents(none).count() == 0
    only = [(next(i for i in range(100) if held(i)), "never trained words")]
    got = lm.score_documents(spark.createDataFrame(only, "doc_id long, text string")).collect()
    assert (got[0].n_tokens, got[0].n_known, got[0].train_tokens) == (4, 0, 0) and math.isfinite(got[0].score)


def test_texts_reach_workers_in_small_batches(spark, monkeypatch):
    key, during, real = "spark.sql.execution.arrow.maxBytesPerBatch", set(), lm.materialize
    before = spark.conf.get(key)
    monkeypatch.setattr(lm, "materialize", lambda df, name: (during.add(spark.conf.get(key)), real(df, name))[1])
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert during == {"4m"} and spark.conf.get(key) == before
    sizes = lambda batches: (b.from_arrays([b.column(0).slice(0, 1)], names=["text"]) for b in batches)
    texts = spark.range(0, 400, 1, 1).selectExpr("repeat('word ', 20000) as text")
    with lm.small_batches(spark):
        assert texts.mapInArrow(sizes, "text string").count() >= 8


def test_pairs_travel_in_buckets(spark, monkeypatch):
    """Pairs that the head's table misses are neither counted nor asked for as a row each, and scores stay the same."""
    import pyarrow as pa

    rows = [(i, " ".join(f"w{(i * j * j) % 89}" for j in range(120))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    want = {r.doc_id: r.score for r in lm.score_documents(docs).collect()}
    asked, real = [], lm.materialize

    def spy(df, name):
        out = real(df, name)
        if name == "asked":
            asked.append(out.count())
        return out

    monkeypatch.setattr(lm, "PAIRS", 0)
    monkeypatch.setattr(lm, "materialize", spy)
    got = {r.doc_id: r.score for r in lm.score_documents(docs).collect()}
    assert got == pytest.approx(want, rel=1e-9)
    # A row a text, a window and a bucket of it in each slice, instead of one for each of 36,300 tokens.
    assert sum(asked) <= lm.JOINED * (300 + 2 * (1 + 64)) < 2000
    k = np.arange(1000, dtype=np.int64) * 7 - 3000
    buckets, ks, twice = lm.dealt(64, k, k * 2)
    assert all((np.frombuffer(x, np.int64) & 63 == b).all() for b, x in zip(buckets, ks.to_pylist(), strict=True))
    back = lm.unpacked(pa.chunked_array([ks]), np.int64)[0]
    assert sorted(back) == sorted(k) and (lm.unpacked(pa.chunked_array([twice]), np.int64)[0] == back * 2).all()


def test_pairs_of_the_head_stay_in_arrays(spark, monkeypatch):
    """Tables of the head's pairs have a row for a bucket, not for a pair; what is asked for lies in a folder for each kind."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j * j) % 89}" for j in range(120))) for i in range(300)], "doc_id long, text string").coalesce(2)
    rows, kinds, real = {}, set(), lm.materialize

    def spy(df, name):
        out = real(df, name)
        rows[name] = max(rows.get(name, 0), out.count())
        if name == "asked":
            kinds.update(f.split("kind=")[1].split("/")[0] for f in out.inputFiles())
        return out

    monkeypatch.setattr(lm, "materialize", spy)
    monkeypatch.setattr(lm, "HEAD", 50)
    model = lm.Model(docs)
    pairs = model.pairs.count()
    assert pairs > 1000 and sum(model.near.select("k").rdd.map(lambda r: len(r.k) // 8).collect()) > 500
    # Of a bucket: twice and oftener, once; of the parent: a share or two in each task.
    assert rows["near"] <= 2 * 64 + 2 * 64 and rows["counted"] <= 64 + model.far.count() < pairs
    lm.score_documents(docs).count()
    assert kinds == {str(x) for x in range(lm.RARE + lm.FAR_JOINED)}
