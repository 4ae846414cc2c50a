"""Line dedup against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from weirflow.llm import lines
from weirflow.llm.components import components

ROW = "doc_id long, text string, n_chars long, `__salt` int"


def groups_by_force(texts):
    """Components of equal and similar lines over all (doc, line number), by all pairs."""
    found = [(d, k, x) for d, t in enumerate(texts) for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\r\x0b\x0c")]
    distinct = sorted({x for _, _, x in found})
    sets = [lines.cut(x) for x in distinct]
    parent = list(range(len(distinct)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    pairs = {(i, j) for ids in by.values() for a, i in enumerate(ids) for j in ids[a + 1 :]}
    for i, j in pairs:
        if lines.similar(sets[i], sets[j]):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    of = {x: root(i) for i, x in enumerate(distinct)}
    first = {}
    for d, k, x in found:
        first.setdefault(of[x], (d, k))
    return {(d, k) for d, k, x in found if first[of[x]] != (d, k)}


def dropped(spark, texts):
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(texts)], ROW).repartition(3)
    _, gone = lines.drops(docs)
    return {(r.doc_id, k) for r in gone.collect() for k in r["drop"]}


def test_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    want = groups_by_force([r.text for r in rows])
    _, gone = lines.drops(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = {(r.doc_id, k) for r in gone.collect() for k in r["drop"]}
    index = {r.doc_id: i for i, r in enumerate(rows)}
    got = {(index[d], k) for d, k in got}
    assert got <= want and len(got) >= 0.99 * len(want)


def family(rng, n, edits):
    base = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{i:03d}word" for i in range(60)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(edits):
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block", [500, 7])
def test_families_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(lines, "BLOCK", block)
    rng = random.Random(3)
    texts = ["\n".join([a, b, f"own line of document number {i} and nothing else {rng.random()}"]) for i, (a, b) in enumerate(zip(family(rng, 40, 1), family(rng, 40, 6), strict=True))]
    got, want = dropped(spark, texts), groups_by_force(texts)
    assert got <= want and len(got) >= 0.97 * len(want)


def test_recall_of_short_lines(spark):
    """Pairs of lines of 11 to 37 characters at Jaccard 0.8 exactly."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    texts = []
    for shingles in (4, 8, 12, 16, 20, 24):
        for _ in range(150):
            line = word(shingles + lines.CHARS - 1)
            texts += [line, line + word(shingles // 4)]
    got, want = dropped(spark, texts), groups_by_force(texts)
    assert len(want) == 900
    assert got <= want and len(got) >= 0.99 * len(want)


def test_the_first_of_equal_lines_stays(spark):
    texts = ["same line here again\nalpha beta gamma delta", "same line here again", "same line here again\nsame line here again\n\n  \nshort", "short", None, "", "\n\n", "kort"]
    docs = spark.createDataFrame([(i, t, len(t or ""), 7) for i, t in enumerate(texts)], ROW)
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert got == {0: texts[0], 1: "", 2: "\n  \nshort", 3: "", 4: None, 5: "", 6: "\n\n", 7: "kort"}
    assert lines.dedup_lines(docs).columns == docs.columns


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "one line of some length", 0, 0), (1, "one line of some length", 0, 0), (None, "one line of some length", 0, 0), (2, "one line of some length", 0, 0)], ROW)
    got = sorted((r.doc_id or 0, r.text) for r in lines.dedup_lines(docs).collect())
    assert got == [(0, "one line of some length"), (1, ""), (1, ""), (2, "")]


def test_empty_table_and_long_lines(spark):
    assert lines.dedup_lines(spark.createDataFrame([], ROW)).count() == 0
    long_line = " ".join(f"w{i}" for i in range(60_000))
    docs = spark.createDataFrame([(1, long_line, 0, 0), (2, long_line + " end", 0, 0), (3, "Grüße aus Köln, schöne Straße überall", 0, 0), (4, "Grüße aus Köln, schöne Straße überal", 0, 0)], ROW)
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs).collect()}
    assert got == {1: long_line, 2: "", 3: "Grüße aus Köln, schöne Straße überall", 4: ""}


def test_union_find(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 300) if i % 37] + [(1000, i) for i in range(1001, 1200)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark, sf_dir):
    got = lines.op10_line_dedup(spark, sf_dir)
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert got.filter("n_kept > n_lines or n_kept < 0").count() == 0
    assert got.filter(F.size(F.split("dropped_lines", ",")) != F.col("n_lines") - F.col("n_kept") + F.when(F.col("dropped_lines") == "", 1).otherwise(0)).count() == 0


def test_a_template_on_many_lines_stays_linear(spark):
    """Rows to compare of a bucket of 20,000 lines of one component and ten others, and of small buckets."""
    rows = lines.parted(spark.range(20_010).selectExpr("1 as band", "7L as key", "0L as pivot", "id as h", "if(id < 20000, 0L, id) as c"))
    assert rows.count() == 19_999 + 10 * 40 + 10
    pairs = rows.filter("side < 2").groupBy("part").agg(F.count("*").alias("n"), F.sum(F.col("side").cast("int")).alias("inner")).collect()
    assert len(pairs) == 40 and sum(r.inner for r in pairs) == 19_999 and all(r.n - r.inner == 10 for r in pairs)
    small = lines.parted(spark.range(30).selectExpr("1 as band", "id % 3 as key", "id % 3 as pivot", "id as h", "id % 2 as c"))
    assert small.count() == 27 and small.filter("side <> 2").count() == 0
    assert lines.parted(spark.range(30).selectExpr("1 as band", "7L as key", "0L as pivot", "id as h", "0L as c")).count() == 0


def test_lines_of_one_template(spark):
    rng = random.Random(11)
    base = " ".join(f"{rng.choice('bcdfg')}{i:03d}word" for i in range(30))
    texts = [f"{base} {rng.randrange(10**6):06d}" for _ in range(2000)] + [" ".join(f"other{rng.randrange(10**6)}" for _ in range(20)) for _ in range(50)]
    assert len(dropped(spark, texts)) == 1999


def test_names_with_dots(spark):
    docs = spark.createDataFrame([(1, "one line of some length", 3)], "doc_id long, text string, `a.b` int")
    assert lines.dedup_lines(docs).columns == docs.columns and lines.dedup_lines(docs).count() == 1


def test_shingles_of_all_scripts_meet():
    """Numbers and texts stand for the same windows in any line."""
    rng = random.Random(13)
    plain = lambda x: {x[i : i + lines.CHARS] for i in range(max(1, len(x) - lines.CHARS + 1))}
    made = ["".join(rng.choice("ab é\xffĀ漢"[: rng.choice((3, 5, 8))]) for _ in range(rng.randrange(0, 30))) for _ in range(300)]
    for x, y in zip(made, made[1:], strict=False):
        y = x[3:] + y
        assert lines.cut(x) == plain(x) and len(lines.numbers(x)) == len(plain(x)) and len(lines.numbers(x) & lines.numbers(y)) == len(plain(x) & plain(y))


def test_shingles_as_numbers_are_exact(monkeypatch):
    """Lines of any characters compare as their sets of shingles do, also when what is remembered is forgotten."""
    rng = random.Random(5)
    kinds = ["abcdefgh ", "abc\xe9\xff ", "ab\0\x01", "ab\u0100\u4e2d\U0001f600", "abcde\ud800"]
    texts = ["", "a", "abcdefg", "\0" * 8, "\x01" + "\0" * 7, "\0" * 9, "\u4e2d" * 8]
    for n in range(300):
        line = "".join(rng.choice(kinds[n % len(kinds)]) for _ in range(rng.randrange(1, 80)))
        texts += [line, line + line[-rng.randrange(1, 9) :], line[:40] + rng.choice(kinds[3]) + line[40:]]
    pairs = [(i, j) for i in range(0, len(texts) - 3) for j in (i + 1, i + 2, i + 3, rng.randrange(len(texts)))]
    want = [lines.similar(lines.cut(texts[i]), lines.cut(texts[j])) for i, j in pairs]
    assert 100 < sum(want) < len(want) - 100
    for held in (lines.HELD, 500):
        monkeypatch.setattr(lines, "HELD", held)
        shingled = lines.Shingled()
        assert [shingled.similar(i, texts[i], j, texts[j]) for i, j in pairs] == want
    assert all(x.dtype == "uint64" for x in shingled.held.values())
