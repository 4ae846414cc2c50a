"""Toxicity by held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from weirflow.llm import toxicity

INSULTS = ["idiot", "moron", "clown", "trash"]


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("abdehilmnorstu") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(15, 120))] + rng.choices(["the", "and", "of", "la", "der"], k=6)
        toxic = int(rng.random() < 0.25)
        if toxic:
            words += rng.choices(INSULTS, k=3) if rng.random() < 0.7 else ["zork" + rng.choice("abcdefgh") * 3]
        rng.shuffle(words)
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def frames(spark):
    rows = corpus()
    return spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), {i: y for i, _, y in rows}


def test_held_out_accuracy(frames):
    docs, labels, truth = frames
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out]
    right = np.mean([r.predicted == truth[r.doc_id] for r in held])
    toxic, clean = [r.score for r in held if truth[r.doc_id]], [r.score for r in held if not truth[r.doc_id]]
    assert right >= 0.95 and np.mean([a > b for a in toxic for b in clean]) >= 0.97


def test_held_out_labels_are_not_read(spark, frames):
    """Scores stay the same if every held-out label is turned round."""
    docs, labels, _ = frames
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.fold() == 0, 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    score = lambda x: {r.doc_id: r.score for r in toxicity.score_documents(docs, x).collect()}
    assert score(labels) == score(turned)


def test_odd_rows(spark, frames):
    _, labels, _ = frames
    rows = [(1, None), (2, ""), (2, ""), (None, "idiot"), (3, "word " * 100_000), (4, "!!! ???"), (5, "one")]
    got = toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), labels.limit(0)).collect()
    assert [r.score for r in got] == [0.0] * 7
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus(200)] + [(1000 + k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    assert len(got) == 207 and all(0 <= r.score <= 1 for r in got.values()) and got[1000].score == got[1001].score
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_threshold():
    assert 1 < toxicity.threshold([0, 1, 2, 3], [0, 0, 1, 1]) < 2


def test_scores_by_brute_force(spark, frames):
    """The network word by word and place by place, from its weights."""
    docs, labels, _ = frames
    net, cuts = toxicity.fit(*toxicity.sample(docs, labels, toxicity.PER_CLASS))
    texts = {r.doc_id: r.text for r in docs.limit(40).collect()} | {9001: "", 9002: "one", 9003: "zorkaaa idiot", 9004: "Der IDIOT und das, trash!"}

    def by_hand(text):
        words = text.encode().translate(toxicity.WORDS).split()
        vectors = []
        for w in words:
            t = w.decode()
            parts = (b"w" + w, b"a" + t[:4].encode(), b"b" + t[:5].encode(), b"z" + t[-4:].encode())
            vectors.append(np.mean([net.embed[zlib.crc32(x) % toxicity.BUCKETS] for x in parts], axis=0))
        logit = float(net.off)
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                places = [sum(float(vectors[i + j] @ net.filters[width][j, :, f]) for j in range(width)) + float(net.bias[width][f]) for i in range(len(words) - width + 1)]
                logit += max([0.0, *places]) * float(net.out[k * toxicity.FILTERS + f])
        votes = [sum(w.decode() in listed for w in words) for listed in toxicity.LANGUAGES.values()]
        language = votes.index(max(votes)) if any(votes) else -1
        return 1 / (1 + np.exp(-(logit - cuts.get(language, cuts[-1]))))

    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    both = docs.unionByName(rows.filter("doc_id > 9000").withColumn("score", toxicity.F.lit("x")))
    got = {r.doc_id: r.score for r in toxicity.score_documents(both, labels).collect()}
    for i, t in texts.items():
        assert got[i] == pytest.approx(by_hand(t), rel=1e-3, abs=1e-5)


def test_long_texts_are_scored_but_not_sampled(spark, frames):
    docs, labels, _ = frames
    long = docs.withColumn("text", toxicity.F.when(toxicity.F.col("doc_id") % 2 == 0, toxicity.F.repeat("text", 200)).otherwise(toxicity.F.col("text")))
    texts, _ = toxicity.sample(long, labels, 10_000)
    assert texts and max(len(t.encode()) for t in texts) <= toxicity.LONGEST and toxicity.score_documents(long, labels).count() == 600
