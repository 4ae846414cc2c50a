"""Quality rules: SQL, odd rows, and thresholds that follow their group."""

import random

from weirflow.durable import materialize
from weirflow.llm import quality


def test_query(same):
    same(quality.op4_quality_rules, quality.SQL["op4_quality_rules"])


def by_hand(text):
    t = text or ""
    words = [w for w in t.replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    lines = [x for x in t.split("\n") if x.strip(" \t\r\x0b\x0c")]
    seen, at = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            at |= {i + k for i in places for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(at)


def test_measures(spark):
    rng = random.Random(1)
    texts = [None, "", "  \n\t", "a", "w " * 7, "w " * 8, "w " * 9, "w " * 100, "x y z\nx y z\n\n \nx y z", "ä # ß\r\nß|<>\x0b$", "\n", "a b c"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 400))) for _ in range(40)] + [("one two three four five six seven eight nine " * 2 + str(i)) for i in range(3)] + ["tok " * 60_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: tuple(r[f"__q_{m}"] for m in quality.METRICS) for r in quality.measure(rows).collect()}
    assert got == {i: by_hand(t) for i, t in enumerate(texts)}


def clean(rng, symbols=0.0):
    return " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" + ("#" if rng.random() < symbols else "") for _ in range(100))


def test_thresholds_follow_their_group(spark):
    """A source that is rich in symbols keeps its texts; the same text elsewhere goes."""
    rng = random.Random(2)
    rows = [(i, clean(rng), "en", "plain", "k") for i in range(150)] + [(1000 + i, clean(rng, 0.95), "en", "code", "k") for i in range(150)]
    rows += [(2000, clean(rng, 0.95), "en", "plain", "k"), (2001, clean(rng), None, None, "k"), (2002, None, "en", "plain", "k"), (2003, "few words", None, "plain", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string")
    out = quality.filter_documents(docs)
    kept = {r.doc_id for r in out.collect()}
    assert out.columns == docs.columns
    assert kept == set(range(150)) | set(range(1000, 1150)) | {2001}


def test_limits_differ_by_group_and_every_rule_rejects(spark):
    """The same upper tail of repeats and runs is normal in one source and rejected in another."""
    rng = random.Random(5)
    line = lambda: clean(rng).replace(" ", "\n", 20)
    again = lambda t, n: t + " " + " ".join(t.split()[:n])
    runs = lambda t, n: t + " no" * n
    rows = [(i, clean(rng), "en", "plain") for i in range(1000)] + [(5000 + i, again(clean(rng), 8 + rng.randrange(8)), "en", "songs") for i in range(1000)]
    odd = [again(clean(rng), 12), runs(clean(rng), 6), clean(rng).upper(), clean(rng, 0.9), line() + "\nsame words here" * 6]
    rows += [(9000 + k, t, "en", "plain") for k, t in enumerate(odd)] + [(9100, odd[0], "en", "songs")]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "docs")
    kept = {r.doc_id for r in quality.filter_documents(docs).collect()}
    assert kept >= set(range(1000)) | {9100} and not kept & set(range(9000, 9005)) and len(kept & set(range(5000, 6000))) >= 990
    found = {(r.source, r.rule): r for r in quality.rejections(materialize(quality.measure(docs), "measured")).collect()}
    assert {rule for (source, rule), r in found.items() if source == "plain" and r.n_over} == set(quality.RULES)
    assert found["songs", "repeats"]["limit"] > found["plain", "repeats"]["limit"]


def test_names_with_dots(spark):
    docs = spark.createDataFrame([(1, "word " * 5, "en", "s", 3)], "doc_id long, text string, lang string, source string, `a.b` int")
    assert quality.filter_documents(docs).columns == docs.columns


def test_repeats_and_empty_tables(spark):
    rng = random.Random(3)
    text = clean(rng)
    docs = spark.createDataFrame([(1, text, "en", "s")] * 3, "doc_id long, text string, lang string, source string")
    assert quality.filter_documents(docs).count() == 3
    assert quality.filter_documents(docs.limit(0)).count() == 0


def test_main_path_is_native(spark, sf_dir):
    plan = quality.judge(quality.measure(spark.read.parquet(f"{sf_dir}/documents.parquet")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
