"""Toxicity by a convolutional text classifier in numpy, with thresholds calibrated by language.

A word (lower-cased A-Z; digits, letters and all that is not ASCII) is the mean of hashed embeddings of
itself, its first four and five characters and its last four.  Filters of widths 1, 2 and 3 slide over
the words of the whole text; the maximum of each over all places feeds a logistic output.  The first
dimension of an embedding starts at the shrunk log odds of its bucket in the training texts, so training
(Adagrad) starts from words that tell the classes apart; pooling then sharpens them.

Training takes a bounded sample: at most ``PER_CLASS`` labelled texts of each class, the least by a hash
of doc_id, from rows outside the held-out fifth; of them those of at most ``LONGEST`` bytes, so the driver gets
``2 * PER_CLASS * LONGEST`` bytes at most.  Texts of any length are scored.  A quarter of the sample sets the thresholds: one for
each language that the text itself shows by its function words, which shifts the logit so that a score
of 0.5 is the threshold.  A threshold weighs a share of clean texts that are called toxic ``FALSE_ALARM`` times a
share of toxic texts that are missed, as clean texts are many more.  Scores read the text alone.

Defined cases: null and empty texts score as a text without words; rows without a label are only
scored; null labels are ignored; a null doc_id counts as the text '' for the fold; without labels of both
classes every score is 0; repeated rows score alike; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.licences import WORDS

PER_CLASS, LONGEST, FALSE_ALARM = 2500, 1 << 14, 4
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
EPOCHS, BATCH, RATE, SEED = 4, 16, 0.1, 11
CACHE_WORDS = 400_000
#: Frequent function words of four languages.
LANGUAGES = {
    "en": ("the", "and", "of", "to", "in", "is", "that", "it", "for", "was"),
    "de": ("der", "die", "und", "das", "von", "zu", "ein", "nicht", "mit", "ist"),
    "fr": ("le", "les", "des", "et", "une", "que", "du", "pour", "dans", "un"),
    "es": ("el", "los", "las", "de", "y", "una", "por", "con", "del", "su"),
}
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def fold() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5


class Words:
    """Rows of hashed features for words, with a bounded cache."""

    def __init__(self):
        import numpy as np

        self.ids: dict[bytes, int] = {}
        self.table = np.zeros((1024, 4), np.int32)
        self.votes = {w.encode(): k for k, ws in enumerate(LANGUAGES.values()) for w in ws}
        self.lang = np.full(1024, -1, np.int8)

    def rows(self, text: str | None):
        """Indexes into ``table`` of the words of a text."""
        import numpy as np

        words = (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()
        ids = self.ids
        for w in set(words):
            if w in ids:
                continue
            k = len(ids)
            if k == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.lang = np.concatenate([self.lang, np.full_like(self.lang, -1)])
            ids[w] = k
            s = w.decode("utf-8", "replace")
            for j, part in enumerate((b"w" + w, b"a" + s[:4].encode(), b"b" + s[:5].encode(), b"z" + s[-4:].encode())):
                self.table[k, j] = zlib.crc32(part) % BUCKETS
            self.lang[k] = self.votes.get(w, -1)
        return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))

    def full(self) -> bool:
        return len(self.ids) > CACHE_WORDS

    def language(self, rows) -> int:
        """The language with most function words; -1 without any."""
        import numpy as np

        seen = self.lang[rows]
        votes = np.bincount(seen[seen >= 0], minlength=len(LANGUAGES))
        return int(votes.argmax()) if votes.any() else -1


class Network:
    """Hashed embeddings, filters, maximum over places, logistic output."""

    def __init__(self, prior):
        import numpy as np

        rng = np.random.default_rng(SEED)
        self.embed = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
        self.embed[:, 0] = prior
        self.filters = {w: rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        for w in WIDTHS:
            self.filters[w][:, 0, : FILTERS // 2] += 1.0 / w
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = np.full(FILTERS * len(WIDTHS), 0.1, np.float32)
        self.off = np.float32(0)

    def projected(self, table):
        """Each word's part of each filter at each of its places: {width: (places, words, FILTERS)}."""
        x = self.embed[table].mean(axis=1)
        return {w: [x @ f[k] for k in range(w)] for w, f in self.filters.items()}

    def pooled(self, parts, rows):
        """Features of one text and the place of each maximum (-1: no place)."""
        import numpy as np

        feats, where = [], []
        for w in WIDTHS:
            n = len(rows) - w + 1
            if n <= 0:
                feats.append(np.zeros(FILTERS, np.float32))
                where.append(np.full(FILTERS, -1))
                continue
            conv = parts[w][0][rows[:n]]
            for k in range(1, w):
                conv = conv + parts[w][k][rows[k : n + k]]
            at = conv.argmax(axis=0)
            top = conv[at, np.arange(FILTERS)] + self.bias[w]
            feats.append(np.maximum(top, 0))
            where.append(np.where(top > 0, at, -1))
        return np.concatenate(feats), np.concatenate(where)

    def logit(self, feats) -> float:
        return float(feats @ self.out + self.off)

    def train(self, words: Words, texts: list, labels: list) -> None:
        import numpy as np

        rng = np.random.default_rng(SEED)
        past: dict = {}

        def step(name, value, grad):
            seen = past.setdefault(name, np.full(value.shape, 0.01, np.float32))
            seen += grad * grad
            value -= RATE * grad / np.sqrt(seen)

        seen_embed = np.full(self.embed.shape, 0.01, np.float32)
        weight = {y: len(labels) / (2 * max(1, labels.count(y))) for y in (0, 1)}
        for _ in range(EPOCHS):
            order = rng.permutation(len(texts))
            for b in range(0, len(order), BATCH):
                group = order[b : b + BATCH]
                uniq, inverse = np.unique(np.concatenate([texts[i] for i in group]), return_inverse=True)
                parts, at = self.projected(words.table[uniq]), 0
                g_out, g_off = np.zeros_like(self.out), 0.0
                g_filters = {w: np.zeros_like(f) for w, f in self.filters.items()}
                g_bias = {w: np.zeros_like(f) for w, f in self.bias.items()}
                touched, grads = [], []
                for i in group:
                    rows = inverse[at : at + len(texts[i])]
                    at += len(texts[i])
                    feats, where = self.pooled(parts, rows)
                    p = 1 / (1 + np.exp(-np.clip(self.logit(feats), -30, 30)))
                    d = np.float32((p - labels[i]) * weight[labels[i]] / len(group))
                    g_out += d * feats
                    g_off += d
                    for j in np.flatnonzero(where >= 0):
                        w, f = WIDTHS[j // FILTERS], j % FILTERS
                        push = d * self.out[j]
                        g_bias[w][f] += push
                        for k in range(w):
                            buckets = words.table[uniq[rows[where[j] + k]]]
                            g_filters[w][k, :, f] += push * self.embed[buckets].mean(axis=0)
                            touched.append(buckets)
                            grads.append(push * self.filters[w][k, :, f] / 4)
                step("out", self.out, g_out)
                off = np.array([self.off], np.float32)
                step("off", off, np.array([g_off], np.float32))
                self.off = off[0]
                for w in WIDTHS:
                    step(("f", w), self.filters[w], g_filters[w])
                    step(("b", w), self.bias[w], g_bias[w])
                if touched:
                    flat, back = np.unique(np.concatenate(touched), return_inverse=True)
                    total = np.zeros((len(flat), DIM), np.float32)
                    np.add.at(total, back, np.repeat(np.array(grads), 4, axis=0))
                    seen_embed[flat] += total * total
                    self.embed[flat] -= RATE * 0.2 * total / np.sqrt(seen_embed[flat])


def log_odds(words: Words, texts: list, labels: list):
    """Shrunk log odds of each bucket: how many texts of either class hold it."""
    import numpy as np

    df = np.zeros((2, BUCKETS))
    for rows, y in zip(texts, labels, strict=True):
        df[y, np.unique(words.table[rows])] += 1
    total = np.bincount(labels, minlength=2)
    odds = np.log((df[1] + 0.5) / (total[1] + 1)) - np.log((df[0] + 0.5) / (total[0] + 1))
    seen = df.sum(axis=0)
    return (odds * seen / (seen + 10)).astype(np.float32)


def threshold(logits, labels) -> float:
    """The logit between texts that tells the classes apart with the fewest weighted errors."""
    import numpy as np

    order = np.argsort(logits)
    x, y = np.array(logits)[order], np.array(labels)[order]
    missed = np.concatenate([[0], np.cumsum(y)]) / max(1, y.sum())
    wrong = ((1 - y).sum() - np.concatenate([[0], np.cumsum(1 - y)])) / max(1, (1 - y).sum())
    cost = missed + FALSE_ALARM * wrong
    best = np.flatnonzero(cost <= cost.min() + 1e-9)
    cut = best[len(best) // 2]
    lower, upper = x[max(0, cut - 1)], x[min(len(x) - 1, cut)]
    return float((lower + upper) / 2)


def fit(texts: list[str], labels: list[int]):
    """A trained network and its thresholds by language (-1: all); None without both classes."""
    import numpy as np

    if len(set(labels)) < 2:
        return None
    words = Words()
    rows = [words.rows(t) for t in texts]
    rng = np.random.default_rng(SEED)
    checks = rng.random(len(rows)) < 0.25
    train = [i for i in range(len(rows)) if not checks[i]]
    tests = [i for i in range(len(rows)) if checks[i]]
    if len({labels[i] for i in train}) < 2:
        train = list(range(len(rows)))
    net = Network(log_odds(words, [rows[i] for i in train], [labels[i] for i in train]))
    net.train(words, [rows[i] for i in train], [labels[i] for i in train])
    by: dict[int, list] = {-1: []}
    for i in tests or train:
        uniq, inverse = np.unique(rows[i], return_inverse=True)
        logit = net.logit(net.pooled(net.projected(words.table[uniq]), inverse)[0])
        by.setdefault(words.language(rows[i]), []).append((logit, labels[i]))
        if words.language(rows[i]) != -1:
            by[-1].append((logit, labels[i]))
    cuts = {}
    for k, x in by.items():
        if k == -1 or (len(x) >= 40 and len({y for _, y in x}) == 2):
            cuts[k] = threshold(*zip(*x, strict=True)) if len({y for _, y in x}) == 2 else 0.0
    return net, cuts


def scorer(model):
    """A mapInArrow function over (doc_id, held_out, text); ``model`` is a broadcast of fit()."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        fitted, words = model.value, Words()

        def out(ids, held, scores):
            return pa.RecordBatch.from_arrays([ids, held, pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

        for batch in batches:
            if fitted is None:
                yield out(batch.column(0), batch.column(1), [0.0] * len(batch))
                continue
            net, cuts = fitted
            scores, texts, at = [], batch.column(2), 0
            while at < len(texts):
                rows, held = [], 0
                while at < len(texts) and held < 300_000:
                    rows.append(words.rows(texts[at].as_py()))
                    held += len(rows[-1])
                    at += 1
                uniq, inverse = np.unique(np.concatenate(rows), return_inverse=True)
                parts, k = net.projected(words.table[uniq]), 0
                for r in rows:
                    logit = net.logit(net.pooled(parts, inverse[k : k + len(r)])[0])
                    k += len(r)
                    cut = cuts.get(words.language(r), cuts[-1])
                    scores.append(float(1 / (1 + np.exp(-np.clip(logit - cut, -30, 30)))))
                if words.full():
                    words = Words()
            yield out(batch.column(0), batch.column(1), scores)

    return run


def sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[list[str], list[int]]:
    """The bounded training sample."""
    known = labels.filter(F.col("toxic").isin(0, 1) & (fold() != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = None
    for y in (0, 1):
        part = known.filter(F.col("toxic") == y).orderBy(*order).limit(per_class)
        picked = part if picked is None else picked.union(part)
    short = docs.select("doc_id", "text").filter(F.octet_length(F.coalesce("text", F.lit(""))) <= LONGEST)
    rows = short.join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * per_class).collect()
    return [r.text or "" for r in rows], [r.toxic for r in rows]


def score_documents(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Score every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(*sample(docs, labels, per_class)))
    rows = docs.select("doc_id", (fold() == 0).alias("held_out"), "text")
    return rows.mapInArrow(scorer(model), SCHEMA)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op7_toxicity": op7_toxicity}
SQL: dict[str, str] = {}
