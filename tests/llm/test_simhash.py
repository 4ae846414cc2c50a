"""SimHash against brute force."""

import random

import xxhash

from weirflow.llm import simhash


def by_hand(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def components(prints):
    """Smallest id reachable over at most four differing bits."""
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    prints = {r.doc_id: by_hand(r.text) for r in docs}
    got = simhash.op5_simhash(spark, sf_dir).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {r.doc_id: r.component_id for r in got} == components(prints)


def test_matches_spark_hash(spark):
    row = spark.range(1).selectExpr("xxhash64('the quick brown fox') as h").first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest(b"the quick brown fox", 42)


def test_links_of_random_bits(spark):
    """Chains and clusters of fingerprints with up to six flipped bits."""
    rng = random.Random(2)
    prints = []
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(12):
            prints.append(x)
            y = x if rng.random() < 0.5 else prints[-1]
            for b in rng.sample(range(64), rng.randrange(0, 7)):
                y ^= 1 << b
            prints.append(y)
            x = y if rng.random() < 0.3 else x
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints} | {0, -1})
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    got, long = ({r.fp: r.root for r in simhash.link(frame, chain).collect()} for chain in (2, 3))
    assert got == long
    want = components({p: p % (1 << 64) for p in signed})
    sizes = {}
    for r in want.values():
        sizes[r] = sizes.get(r, 0) + 1
    assert got == {p: r for p, r in want.items() if sizes[r] > 1}


def test_every_close_pair_has_a_chain():
    """The ring principle: a pair at distance four or less meets by some key, whatever bits differ."""
    rng = random.Random(4)
    segment = lambda x, i: x >> simhash.RING[i % 5][0] & ((1 << simhash.RING[i % 5][1]) - 1)
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5)))
        ones = [bin(segment(diff, i)).count("1") for i in range(5)]
        assert any(all(sum(ones[(i + j) % 5] for j in range(k)) <= 4 * k // 5 for k in range(1, 6)) for i in range(5))


def test_odd_rows(spark):
    rows = [(3, None, 1), (2, "", 1), (None, " \n", 1), (9, "One two", 1), (8, "one TWO", 1), (7, "äÖ ß", 1), (6, "äÖ ß", 1), (6, "äÖ ß", 1), (None, "lonely words here", 1), (5, "lang " * 50_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id if r.doc_id is not None else -1), -1 if r.component_id is None else r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(-1, -1), (-1, 2), (2, 2), (3, 2), (5, 5), (6, 6), (6, 6), (7, 6), (8, 8), (9, 8)]
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect()) == [-1, 2, 5, 6, 8]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_keys_grow_with_the_number_of_fingerprints():
    assert simhash.chain_for(10**6) == 2 and simhash.chain_for(10**11) == 3
    assert [len(simhash.flips(0, chain)) for chain in (1, 2, 3)] == [1, 14, 274]


def test_no_join_is_broadcast_by_estimates(spark, sf_dir, monkeypatch):
    """Spark's estimate of a table knows nothing of the keys made of each fingerprint."""
    plans = []
    note = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    for name in ("materialize", "components"):
        monkeypatch.setattr(simhash, name, lambda df, *a, f=getattr(simhash, name): (note(df), f(df, *a))[1])
    note(simhash.op5_simhash(spark, sf_dir))
    assert sum("Join" in p for p in plans) >= 7
    assert [p for p in plans if "Broadcast" in p] == []


def test_names_with_dots(spark):
    docs = spark.createDataFrame([(1, "some words here", 3)], "doc_id long, text string, `a.b` int")
    assert simhash.drop_near_duplicates(docs).columns == docs.columns
