"""Language-model scores by a hierarchical Pitman-Yor process.

Tokens are words (A-Z lower-cased) and one end per text.  Every word, and the start of a text, is a context with a
restaurant of its own; all share one parent, the restaurant of single words, whose base measure is even over
the vocabulary and one word more for all unseen.  Nothing is cut off or folded: pairs, contexts and words are
distributed tables that grow with the input.

Seating is sampled by blocked Gibbs sweeps: the customers of a dish leave a restaurant and are seated anew one
by one (beyond 16 customers in steps of a sixteenth, by a binomial draw), at a new table with weight
``(strength + discount * tables) * parent(dish)``; tables send customers to the parent, whose dishes are then
seated in turn (the head's on the driver, all others where they lie).  Dishes are sampled in parallel given the last state.  A dish of one customer has one
table, so pairs that occur once are never stored: their numbers follow from the counts of words.  Predictive
probabilities are averaged over the sweeps after the burn-in.  Discounts come from the numbers of counts one and two.

A text is scored where it is read, as far as two bounded tables that are sent to all tasks reach (at most ``HEAD``
words with their figures, ``PAIRS`` pairs with their predictions); they save work, of the results only the random draws
differ with ``HEAD``.  All other pairs of the head's words are scored as pairs that no table has, and asked for: the hashes that a window
of texts asks for go to buckets, one binary row for each bucket, meet what the pairs there add, and go back to their window.  The number of buckets grows with the
tokens.  Pairs with rarer words are joined row by row with the distributed tables.  Pairs are counted in such buckets too, and those of the head's
words stay in them, an array for each figure, while they are seated, priced and asked for.  To bound the disk, pairs are counted and joined
in ``COUNTED`` and ``JOINED`` slices by hash, each with a pass over the texts, pairs with rarer words in ``FAR_JOINED``, and no two joins of a slice keep their exchanges at once.

Words are identified by a 64-bit hash, rows by a hash of doc_id and text.  Defined cases: null and empty texts are
the end alone; a null doc_id counts as the text '' for the fold; without training texts the vocabulary is empty
and scores fall back on the base measure; repeated rows are scored each on its own and train as often as
they occur; texts of any length are read in pieces; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.durable import discard, folders_by, materialize, scope

SWEEPS, BURN, SEED = 3, 1, 5
STRENGTH = 1.0
HEAD, PAIRS = 400_000, 1_000_000
COUNTED, JOINED, FAR_JOINED = 2, 2, 4
#: Bytes of text that are read at once, and tokens that are counted before they are sent.
PIECE, WINDOW = 1 << 18, 1_000_000
#: Tokens of the training texts for each bucket of pairs.
BUCKET = 250_000
#: Words of the head whose sums travel together.
SHARE = 8192
END, START = 1, 2


#: Bytes that are sent to a Python worker at once; texts in Spark's default of 64 MB stand in the executor's memory several times.
BATCH = "4m"


@contextmanager
def small_batches(spark) -> Iterator[None]:
    """Queries that run inside send BATCH bytes at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fold() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5


@lru_cache(1)
def hashing(n: int):
    """Bytes as random numbers (0 for white space, A-Z as a-z), and powers and inverse powers of an odd base up to n."""
    import numpy as np

    table = np.random.default_rng(SEED).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    table[65:91] = table[97:123]
    table[[9, 10, 11, 12, 13, 32]] = 0
    base = 0x9E3779B97F4A7C15
    powers = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, x, np.uint64))), dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64))]
    return table, *powers


def mixed(x):
    """Spread the bits of hashes."""
    import numpy as np

    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    return x


def pair_hash(u, w):
    """What Spark's xxhash64 gives for two long columns."""
    import numpy as np

    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    h = np.full(len(u), 42, np.uint64)
    for x in (u, w):
        h = h + p5 + np.uint64(8)
        h ^= turn(x.view(np.uint64) * p2, 31) * p1
        h = turn(h, 27) * p1 + p4
        h ^= h >> np.uint64(33)
        h *= p2
        h ^= h >> np.uint64(29)
        h *= p3
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


class Reader:
    """Tokens of a column of texts, by pieces of about PIECE bytes: (row, context, word) as arrays.

    A text that goes on in the next piece takes its last word along as context.
    """

    def __init__(self, column):
        import numpy as np
        import pyarrow as pa

        column = column.fill_null("").cast(pa.large_string())
        _, offsets, data = column.buffers()
        self.at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        self.data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)

    def spans(self) -> Iterator[list[tuple[int, int, int]]]:
        """Lists of (row, first byte, end), a long text cut behind white space."""
        held, size = [], 0
        for row in range(len(self.at) - 1):
            here, end = int(self.at[row]), int(self.at[row + 1])
            while True:
                cut = end
                if end - here > PIECE:
                    cut = here + PIECE
                    while cut < end and self.data[cut - 1] not in b"\t\n\x0b\x0c\r ":
                        cut += 1
                held.append((row, here, cut))
                size += cut - here
                if size >= PIECE:
                    yield held
                    held, size = [], 0
                here = cut
                if here >= end:
                    break
        if held:
            yield held

    def __iter__(self):
        import numpy as np

        carry = START
        for spans in self.spans():
            row, first, last = np.array(spans, np.int64).T
            low = int(first[0])
            raw = self.data[low : int(last[-1])]
            table, power, inverse = hashing(1 << max(19, len(raw).bit_length()))
            codes = table[raw]
            inside = np.concatenate(([False], codes != 0, [False]))
            starts = inside[1:-1] & ~inside[:-2]
            ends = inside[1:-1] & ~inside[2:]
            new = first[last > first] - low
            starts[new] = inside[1:-1][new]
            ends[(new - 1)[new > 0]] = inside[1:-1][(new - 1)[new > 0]]
            s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * power[: len(codes)], dtype=np.uint64)))
            words = mixed((sums[e] - sums[s]) * inverse[s]).view(np.int64)
            # Words and ends in one line; the place of a word is its number and the ends before its span.
            begins, closes = first == self.at[row], last == self.at[row + 1]
            before = np.cumsum(closes) - closes
            span = np.searchsorted(first - low, s, side="right") - 1
            upto = np.searchsorted(span, np.arange(len(row)), side="right")
            token, of = np.full(len(words) + closes.sum(), END, np.int64), np.empty(len(words) + closes.sum(), np.int64)
            at = np.arange(len(words)) + before[span]
            token[at], of[at] = words, row[span]
            of[(upto + before)[closes]] = row[closes]
            context = np.concatenate(([carry], token))
            context[(np.concatenate(([0], upto[:-1])) + before)[begins]] = START
            carry = context[-1]
            yield of, context[:-1], token


def _batch(columns: dict):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))


def packed(values, counts):
    """An array as binary values of so many elements each."""
    import numpy as np
    import pyarrow as pa

    offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts))) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column, kind):
    """The elements of a column of binary values in one array, and their numbers by value."""
    import numpy as np

    found = column.to_pylist()
    return np.frombuffer(b"".join(found), kind), np.array([len(x) for x in found], np.int64) // np.dtype(kind).itemsize


def dealt(buckets: int, k, *columns):
    """Rows by bucket, the low bits of ``k``: the buckets that have any, and ``k`` and the columns as binary values."""
    import numpy as np

    of = (k & (buckets - 1)).astype(np.min_scalar_type(buckets - 1))
    order = np.argsort(of, kind="stable")
    counts = np.bincount(of, minlength=buckets)
    used = np.flatnonzero(counts)
    return used.astype(np.int32), *[packed(x[order], counts[used]) for x in (k, *columns)]


def _count_words(buckets: int):
    """A mapInArrow function over texts: (w, c) by bucket."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        held, size = [], 0

        def out():
            return _batch(dict(zip(("bucket", "w", "c"), dealt(buckets, *np.unique(np.concatenate(held), return_counts=True)), strict=True)))

        for batch in batches:
            for _, _, w in Reader(batch.column(0)):
                held.append(w)
                size += len(w)
                if size > WINDOW:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


def _added_words(rows):
    """The words of a bucket with their counts."""
    import numpy as np
    import pyarrow as pa

    (w, _), (c, _) = unpacked(rows["w"], np.int64), unpacked(rows["c"], np.int64)
    order = np.argsort(w)
    w, c = w[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
    return pa.table({"w": w[first], "c": np.add.reduceat(c, first)})


def _count_pairs(buckets: int, part: int):
    """A mapInArrow function over (held_out, text): (u, w, c) of the pairs in a slice by bucket; c is 0 for held-out texts."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        held, size = [[], []], 0

        def out():
            for flag in (0, 1):
                if held[flag]:
                    u, w, k = (np.concatenate(x) for x in zip(*held[flag], strict=True))
                    _, at, c = np.unique(k, return_index=True, return_counts=True)
                    of, _, *columns = dealt(buckets, k[at], u[at], w[at], (c * (1 - flag)).astype(np.int32))
                    yield _batch(dict(zip(("bucket", "u", "w", "c"), (of, *columns), strict=True)))
                    held[flag].clear()

        for batch in batches:
            asked = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for row, u, w in Reader(batch.column(1)):
                k = pair_hash(u, w)
                mine = (k & (COUNTED - 1)) == part
                for flag in (0, 1):
                    take = mine & (asked[row] == flag)
                    held[flag].append((u[take], w[take], k[take]))
                size += int(mine.sum())
                if size > WINDOW:
                    yield from out()
                    size = 0
        yield from out()

    return run


CELLS = "u long, w long, c long, iu int, iw int, bucket int, n long, n2 long, hu binary, hw binary, hc binary"


def _added_up(rows, sent):
    """CELLS: the pairs of a bucket that occur twice or more in training texts, or once and in held-out texts too.

    A row for each pair with a rarer word, with the places of both words in the head (-1 for others), and one for those of the head's words: places and
    counts as arrays (hu, hw, hc), the customers of all that occur twice or more (n), and how many occur twice (n2).
    """
    import numpy as np
    import pyarrow as pa

    words = indexes(sent.value)[0]
    (u, _), (w, _), (c, _) = (unpacked(rows[x], kind) for x, kind in (("u", np.int64), ("w", np.int64), ("c", np.int32)))
    k = pair_hash(u, w)
    order = np.argsort(k)
    k, c = k[order], c[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    total, least = np.add.reduceat(c, first), np.minimum.reduceat(c, first)
    kept = (total > 1) | (total == 1) & (least == 0)
    at, c = order[first[kept]], total[kept]
    u, w = u[at], w[at]
    iu, iw = words.get_indexer(u).astype(np.int32), words.get_indexer(w).astype(np.int32)
    far = (iu < 0) | (iw < 0)
    rows_of = [pa.concat_arrays([pa.array(x[far]), pa.nulls(1, pa.array(x[:0]).type)]) for x in (u, w, c, iu, iw)]
    hu, hw, hc = iu[~far], iw[~far], c[~far]
    own = [rows["bucket"].combine_chunks()[:1], pa.array([hc[hc > 1].sum()], pa.int64()), pa.array([(hc == 2).sum()], pa.int64()), *[packed(x, [len(x)]) for x in (hu, hw, hc)]]
    own = [pa.concat_arrays([pa.nulls(int(far.sum()), x.type), x]) for x in own]
    return pa.Table.from_arrays(rows_of + own, names=[x.split()[0] for x in CELLS.split(", ")])


def seat(counts, prior, discount: float, strength: float, others, rng):
    """Tables for each dish after its customers were seated anew.

    ``prior``: the parent's probability of each dish; ``others``: tables of all other dishes.
    """
    import numpy as np

    order = np.argsort(-counts, kind="stable")
    c, p, rest = counts[order], prior[order], np.broadcast_to(others, counts.shape)[order]
    tables, n = np.minimum(c, 1).astype(np.int64), 1
    active = int(np.searchsorted(-c, -1, side="left"))  # more than one customer
    while active:
        step = max(1, n // 16)
        t = tables[:active]
        new = (strength + discount * (rest[:active] + t)) * p[:active]
        chance = new / (new + np.maximum(n - discount * t, 1e-9))
        many = np.minimum(step, c[:active] - n)
        tables[:active] = t + (rng.random(active) < chance if step == 1 else rng.binomial(many, chance))
        n += step
        active = int(np.searchsorted(-c[:active], -n, side="left"))
    out = np.empty_like(tables)
    out[order] = tables
    return out


def discount_of(ones: int, twos: int) -> float:
    """The discount that explains the numbers of counts one and two."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def _rng(sweep: int, *values):
    """Random numbers that depend on the seed, the sweep and the rows alone."""
    import numpy as np

    return np.random.default_rng([SEED, sweep, *(int(x.sum()) % (1 << 63) for x in values)])


def _seat_words(even: float, tables: int, discount: float, sweep: int):
    """A mapInArrow function that seats the parent's dishes anew: rows (w, c, t, guests)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        for batch in batches:
            w, c, t, guests = (x.to_numpy() for x in batch.columns)
            if len(w):
                yield _batch({"w": w, "c": c, "t": seat(guests, np.full(len(w), even), discount, STRENGTH, tables - t, _rng(sweep, w, t)), "guests": guests})

    return run


NEAR = "bucket int, iu binary, iw binary, c binary, t binary, acc binary, share int, less binary"
FAR = "u long, w long, c long, cu long, t long, acc double, iu int, iw int"
KINDS = {"iu": "i4", "iw": "i4", "c": "i8", "t": "i8", "acc": "f8", "hu": "i4", "hw": "i4", "hc": "i8", "k": "i8", "lp": "f8"}


def arrays(batches: Iterator, *names: str) -> Iterator[list]:
    """The first column of each row, and the columns named as arrays."""
    import numpy as np

    for batch in batches:
        for i in range(len(batch)):
            yield [batch.column(0)[i].as_py(), *[np.frombuffer(batch.column(x)[i].as_py(), KINDS[x]) for x in names]]


def near_rows(states: Iterator, h: int) -> Iterator:
    """NEAR: rows of (bucket, iu, iw, c, t, acc), and for SHARE of the head's contexts, then words, the customers who share tables (``less``)."""
    import numpy as np
    import pyarrow as pa

    less = np.zeros(-(-2 * h // SHARE) * SHARE, np.int64)
    names = [x.split()[0] for x in NEAR.split(", ")]
    for bucket, iu, iw, c, t, acc in states:
        some = np.flatnonzero(c > t)
        for place in (iu[some], iw[some].astype(np.int64) + h):
            np.add.at(less, place, (c - t)[some])
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *[packed(x, [len(x)]) for x in (iu, iw, c, t, acc)], pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary())], names=names)
    shares = less.reshape(-1, SHARE)
    used = np.flatnonzero(shares.any(axis=1))
    none = [pa.nulls(len(used), pa.int32()), *[pa.nulls(len(used), pa.binary())] * 5]
    yield pa.RecordBatch.from_arrays([*none, pa.array(used, pa.int32()), packed(shares[used].ravel(), np.full(len(used), SHARE))], names=names)


def _placed(h: int):
    """A mapInArrow function over (bucket, hu, hw, hc): NEAR for the pairs that occur twice or more, each at one table."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        def states():
            for bucket, iu, iw, c in arrays(batches, "hu", "hw", "hc"):
                many = c > 1
                yield bucket, iu[many], iw[many], c[many], np.ones(many.sum(), np.int64), np.zeros(many.sum())

        return near_rows(states(), h)

    return run


def _summed(rows):
    """The sums of a share over all tasks."""
    import numpy as np
    import pyarrow as pa

    return pa.table({"share": rows["share"].slice(0, 1), "less": packed(unpacked(rows["less"], np.int64)[0].reshape(-1, SHARE).sum(axis=0), [SHARE])})


def advanced(discount: float, sweep: int, kept: bool, p, cu, tu, iu, iw, c, t, acc):
    """Tables after pairs were seated anew, and ``acc`` with the predictions of a kept state."""
    if kept:
        acc = acc + (c - discount * t) / (STRENGTH + cu) + (STRENGTH + discount * tu) / (STRENGTH + cu) * p
    return seat(c, p, discount, STRENGTH, tu - t, _rng(sweep, c, t, iu, iw)) if sweep <= SWEEPS else t, acc


def _advance_near(figures, discount: float, sweep: int, kept: bool):
    """A mapInArrow function that advances the pairs of the head's words, (bucket, iu, iw, c, t, acc), to NEAR.  The head's figures are sent (words' probabilities, contexts' customers and tables)."""

    def run(batches: Iterator) -> Iterator:
        p, cu, tu = figures.value

        def states():
            for bucket, iu, iw, c, t, acc in arrays(batches, "iu", "iw", "c", "t", "acc"):
                yield bucket, iu, iw, c, *advanced(discount, sweep, kept, p[iw], cu[iu], tu[iu], iu, iw, c, t, acc)

        return near_rows(states(), len(p))

    return run


def _advance(figures, discount: float, sweep: int, kept: bool, names: list[str]):
    """A mapInArrow function that does the same to pairs with rarer words; figures that the head lacks are columns p, tu and cu."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        head_p, head_c, head_t = figures.value
        for batch in batches:
            get = lambda name: batch.column(name).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            iu, iw, c, t, acc = (get(x) for x in ("iu", "iw", "c", "t", "acc"))
            if not len(c):
                continue
            p, cu, tu = np.where(iw < 0, get("p"), head_p[iw]), np.where(iu < 0, get("cu"), head_c[iu]), np.where(iu < 0, get("tu"), head_t[iu])
            new = dict(zip(("t", "acc"), advanced(discount, sweep, kept, p, cu, tu, iu, iw, c, t, acc), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(new[x]) if x in new else batch.column(x) for x in names], names=names)

    return run


def unlisted(head: dict, iu, iw, discount: float):
    """What pairs of the head's words have without a row: the share of the parent, and that of a single customer."""
    return (head["b"][iu] * head["p"][iw]).mean(axis=1), (1 - discount) / (STRENGTH + head["c"][iu])


PRICED = "bucket int, k binary, c binary, lp binary, train binary, held binary"


def priced(bucket: int, *columns):
    """A row of PRICED."""
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *[packed(x, [len(x)]) for x in columns]], names=[x.split()[0] for x in PRICED.split(", ")])


def _priced_pairs(sent, discount: float, kept: int):
    """A mapInArrow function over (bucket, iu, iw, c, acc): PRICED, with what the pairs add to a score that was made without them."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        head = sent.value
        for bucket, iu, iw, c, acc in arrays(batches, "iu", "iw", "c", "acc"):
            back, single = unlisted(head, iu, iw, discount)
            lp = np.log10(acc / kept)
            yield priced(bucket, pair_hash(head["w"][iu], head["w"][iw]), c, lp, lp - np.log10(back + single), lp - np.log10(back))

    return run


def _priced_singles(sent, discount: float):
    """A mapInArrow function over (bucket, hu, hw, hc): PRICED for the pairs seen once, without predictions."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        head = sent.value
        for bucket, iu, iw, c in arrays(batches, "hu", "hw", "hc"):
            iu, iw = iu[c == 1], iw[c == 1]
            back, single = unlisted(head, iu, iw, discount)
            yield priced(bucket, pair_hash(head["w"][iu], head["w"][iw]), np.ones(len(iu), np.int64), np.full(len(iu), np.nan), np.zeros(len(iu)), np.log10(back + single) - np.log10(back))

    return run


def _levels(batches: Iterator) -> Iterator:
    """Rows (b, n, c) of :func:`levels` for each row (bucket, c) of PRICED."""
    import numpy as np

    for _, c in arrays(batches, "c"):
        c, n = np.unique(c[c > 1], return_counts=True)
        yield _batch({"b": np.floor(np.log(c) / np.log(2.0) * 16).astype(np.int64), "n": n, "c": c})


def _listed(least: int):
    """A mapInArrow function over (bucket, k, c, lp) of PRICED: a row (k, c, lp) for each pair that occurs so often."""

    def run(batches: Iterator) -> Iterator:
        for _, k, c, lp in arrays(batches, "k", "c", "lp"):
            yield _batch({"k": k[c >= least], "c": c[c >= least], "lp": lp[c >= least]})

    return run


def _answered(asks, pairs):
    """What a bucket's pairs add to the texts that ask for them: rows (window, at, gain) of the windows with any."""
    import numpy as np
    import pyarrow as pa

    (k, counts), (at, _) = unpacked(asks["k"], np.int64), unpacked(asks["at"], np.int32)
    (known, _), (train, _), (held, _) = unpacked(pairs["k"], np.int64), unpacked(pairs["train"], np.float64), unpacked(pairs["held"], np.float64)
    order = np.argsort(known)
    known = known[order]
    place = np.searchsorted(known, k)
    found = np.flatnonzero(known[np.minimum(place, len(known) - 1)] == k) if len(known) else np.zeros(0, np.int64)
    place, at, window = order[place[found]], at[found], np.repeat(np.arange(len(counts)), counts)[found]
    gain = np.where(at & 1, held[place], train[place])
    # A window's texts come in order, so those of a text lie together.
    text = at >> 1
    first = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (window[1:] != window[:-1]))))[: len(at)]
    sums = np.add.reduceat(gain, first) if len(at) else gain
    counts = np.bincount(window[first], minlength=len(counts))
    some = np.flatnonzero(counts)
    return pa.table({"window": asks["window"].take(pa.array(some)), "at": packed(text[first], counts[some]), "gain": packed(sums, counts[some])})


def _returned(rows):
    """What was added to the texts of a window: rows (uid, score)."""
    import numpy as np
    import pyarrow as pa

    (uid, _), (at, _), (gain, _) = (unpacked(rows[x].drop_null(), kind) for x, kind in (("uids", np.int64), ("at", np.int32), ("gain", np.float64)))
    return pa.table({"uid": uid, "score": np.bincount(at, gain, minlength=len(uid)).astype(np.float64)})


def levels(df: DataFrame) -> DataFrame:
    """Rows (b, n, c): how many rows have a count of level b, and the least such count."""
    return df.filter("c > 0").groupBy(F.floor(F.log2("c") * 16).alias("b")).agg(F.count("*").alias("n"), F.min("c").alias("c"))


def at_most(bins: DataFrame, limit: int) -> int:
    """The least count c so that at most ``limit`` rows have c or more, from their levels."""
    least, total = 1 << 62, 0
    for r in sorted(bins.collect(), key=lambda r: -r.b):
        total += r.n
        if total > limit:
            break
        least = r.c
    return least


class Model:
    """What training leaves: scalars, ``words`` (w, c, b<s>, p<s>), ``near`` (PRICED) and ``far`` (k, c, lp) as written tables.

    ``words`` has the start among its contexts.  For a kept sweep s, b is a context's share for the parent and p the parent's probability of a word.  ``near`` has
    the pairs of the head's words by bucket, ``far`` all others: the predictions of pairs that occur twice or more, and those of the held-out texts that occur
    once without one.  In ``near``, ``train`` and ``held`` are what they add to the score of a text of that fold.
    """

    def __init__(self, docs: DataFrame):
        import numpy as np

        train = docs.filter(fold() != 1)
        # The tokens are not known yet: as many buckets as an exchange has partitions, or up to twice that.
        buckets = 1 << max(6, (int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
        counted = train.select("text").mapInArrow(_count_words(buckets), "bucket int, w binary, c binary").groupBy("bucket")
        vocab = materialize(counted.applyInArrow(_added_words, "w long, c long"), "vocabulary")
        few = [F.sum((F.col("c") == x).cast("long")).alias(f"n{x}") for x in (1, 2)]
        facts = vocab.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("w") == END, F.col("c"))).alias("texts"), *few).first()
        self.n, self.v = facts.n or 0, facts.v
        self.even = 1.0 / (self.v + 1)
        flagged = docs.select((fold() == 1).alias("held_out"), "text")
        least = at_most(levels(vocab), HEAD)
        head = vocab.filter(F.col("c") >= least).toArrow()
        words, c = np.append(head["w"].to_numpy(), START), np.append(head["c"].to_numpy(), facts.texts or 0)
        sent = docs.sparkSession.sparkContext.broadcast({"w": words, "k": words[:0]})
        parts = []
        for part in range(COUNTED):
            found = flagged.mapInArrow(_count_pairs(self.buckets, part), "bucket int, u binary, w binary, c binary").groupBy("bucket").applyInArrow(lambda rows: _added_up(rows, sent), CELLS)
            parts.append(materialize(found, "counted"))
        cells = reduce(DataFrame.union, parts)
        facts2 = cells.agg(F.sum(F.coalesce("n", F.when(F.col("c") > 1, F.col("c")))).alias("n"), F.sum(F.coalesce("n2", (F.col("c") == 2).cast("long"))).alias("n2")).first()
        self.discount = d = discount_of(self.n - (facts2.n or 0), facts2.n2 or 0)
        self._sample(docs.sparkSession, vocab, words, c, least, cells, d, discount_of(facts.n1 or 0, facts.n2 or 0), facts.n1 or 0, facts.texts or 0)
        discard(*parts)

    def _sample(self, spark, vocab: DataFrame, words, c, least: int, cells: DataFrame, d: float, lower: float, ones: int, texts: int) -> None:
        """Run the sweeps.  The head's words are seated on the driver, with all figures in arrays; all others are tables."""
        import numpy as np
        import pandas as pd

        ones = ones if least > 1 else 0  # outside the head
        h, start = len(words), len(words) - 1
        tail = vocab.filter((F.col("c") < least) & (F.col("c") > 1))
        placed = cells.filter("c > 1")
        one, none = F.lit(1).cast("long").alias("t"), F.lit(0.0).alias("acc")
        heads = cells.filter("bucket is not null").select("bucket", "hu", "hw", "hc")
        near = materialize(heads.mapInArrow(_placed(h), NEAR), "near")
        contexts = vocab.select(F.col("w").alias("u"), F.col("c").alias("cu"))
        far = placed.join(contexts.hint("shuffle_hash"), "u", "left")
        far = materialize(far.select("u", "w", "c", F.coalesce("cu", F.lit(texts)).alias("cu"), one, none, "iu", "iw"), "far")
        root, t = tail.select("w", "c", one), np.minimum(c, 1)
        t[start] = 0
        tables, shares, head_b, head_p, self.unseen, self.once = self.v, [], [], [], [], []
        moved = F.sum(F.col("c") - F.col("t")).alias("less")
        for sweep in range(1, SWEEPS + 2):
            kept = sweep > BURN + 1
            # What customers share tables, by word and context: of the head in arrays, of others in tables.
            found = near.filter("share is not null").select("share", "less").groupBy("share").applyInArrow(_summed, "share int, less binary").toArrow()
            both = np.zeros(-(-2 * h // SHARE) * SHARE, np.int64)
            both.reshape(-1, SHARE)[found["share"].to_numpy()] = unpacked(found["less"], np.int64)[0].reshape(-1, SHARE)
            less = {"iu": both[:h], "iw": both[h : 2 * h]}
            for side in less:
                found = far.filter(F.col(side) >= 0).groupBy(side).agg(moved).toArrow()
                less[side] = less[side] + np.bincount(found[side].to_numpy(), found["less"].to_numpy(), minlength=h).astype(np.int64)
            # The parent's customers are the tables of all contexts.
            guests = c - less["iw"]
            guests[start] = 0
            t = seat(guests, np.full(h, self.even), lower, STRENGTH, tables - t, np.random.default_rng([SEED, 1000 + sweep]))
            fewer = far.filter("iw < 0").groupBy("w").agg(moved)
            asked = root.select("w", "c", "t").join(fewer, "w", "left").select("w", "c", "t", (F.col("c") - F.coalesce("less", F.lit(0))).alias("guests"))
            seated = materialize(asked.mapInArrow(_seat_words(self.even, tables, lower, 1000 + sweep), "w long, c long, t long, guests long"), "parent")
            sums = seated.agg(F.sum("t").alias("t"), F.sum("guests").alias("g")).first()
            tables = int(t.sum()) + (sums.t or 0) + ones
            total = STRENGTH + int(guests.sum()) + (sums.g or 0) + ones
            new = (STRENGTH + lower * tables) / total * self.even
            p, tu = (guests - lower * t) / total + new, c - less["iu"]
            root = seated.withColumn("p", (F.col("guests") - lower * F.col("t")) / total + new)
            mine = far.filter("iu < 0").groupBy("u").agg((F.max("cu") - F.sum(F.col("c") - F.col("t"))).alias("tu"), F.max("cu").alias("tc"))
            if kept:
                mine = materialize(mine, "contexts")
                s = len(head_p) + 1
                shares.append((mine.select(F.col("u").alias("w"), ((STRENGTH + d * F.col("tu")) / (STRENGTH + F.col("tc"))).alias(f"b{s}")), root.select("w", F.col("p").alias(f"p{s}"))))
                head_b.append((STRENGTH + d * tu) / (STRENGTH + c))
                head_p.append(p)
                self.unseen.append(new)
                self.once.append((1 - lower) / total + new)
            figures = spark.sparkContext.broadcast((p, c.astype(float), tu.astype(float)))
            names = [x.split()[0] for x in FAR.split(", ")]
            # Rows whose word or context is in the head ask for nothing: they are dealt by hashes that no table has.
            own = lambda x: F.when(F.col(f"i{x}") < 0, F.col(x)).otherwise(F.xxhash64("u", "w", F.lit(x)))
            joined = far.withColumns({"ku": own("u"), "kw": own("w")}).join(root.select(F.col("w").alias("kw"), "p").hint("shuffle_hash"), "kw", "left")
            joined = joined.join(mine.select(F.col("u").alias("ku"), "tu").hint("shuffle_hash"), "ku", "left").select(*names, "p", "tu")
            old = near, far
            near = materialize(near.filter("bucket is not null").select("bucket", "iu", "iw", "c", "t", "acc").mapInArrow(_advance_near(figures, d, sweep, kept), NEAR), "near")
            far = materialize(joined.mapInArrow(_advance(figures, d, sweep, kept, names), FAR), "far")
            discard(*old)
        self.kept = len(head_p)
        self.head_words = {"w": words, "c": c, "b": np.stack(head_b, axis=1), "p": np.stack(head_p, axis=1)}
        sent = spark.sparkContext.broadcast(self.head_words | {"k": words[:0]})
        found = near.filter("bucket is not null").select("bucket", "iu", "iw", "c", "acc").mapInArrow(_priced_pairs(sent, d, self.kept), PRICED)
        self.near = materialize(found.union(heads.mapInArrow(_priced_singles(sent, d), PRICED)), "near")
        found = far.select(F.xxhash64("u", "w").alias("k"), "c", F.log10(F.col("acc") / self.kept).alias("lp"))
        self.far = materialize(found.union(cells.filter("c = 1").select(F.xxhash64("u", "w"), "c", F.lit(None).cast("double"))), "far")
        discard(near, far)
        known = vocab.filter(F.col("c") < least)
        for b, q in shares:
            known = known.join(b.hint("shuffle_hash"), "w", "left").join(q.hint("shuffle_hash"), "w", "left")
        plain = (STRENGTH + d * F.col("c")) / (STRENGTH + F.col("c"))
        known = known.select("w", "c", *[F.coalesce(f"b{s}", plain).alias(f"b{s}") for s in self.sweeps], *[F.coalesce(f"p{s}", F.lit(self.once[s - 1])).alias(f"p{s}") for s in self.sweeps])
        listed = {"w": words, "c": c} | {f"{x}{s}": v[s - 1] for x, v in (("b", head_b), ("p", head_p)) for s in self.sweeps}
        self.words = materialize(known.union(spark.createDataFrame(pd.DataFrame(listed))), "words")

    @property
    def sweeps(self) -> range:
        return range(1, self.kept + 1)

    def listed(self, least: int) -> DataFrame:
        """(k, c, lp): the pairs that occur so often."""
        return self.near.select("bucket", "k", "c", "lp").mapInArrow(_listed(least), "k long, c long, lp double").union(self.far.filter(F.col("c") >= least))

    @property
    def pairs(self) -> DataFrame:
        """(k, c, lp): the pairs that have predictions."""
        return self.listed(2)

    def head(self) -> dict:
        """The bounded tables that are sent to all tasks."""
        bins = self.near.select("bucket", "c").mapInArrow(_levels, "b long, n long, c long").union(levels(self.far.filter("c > 1")))
        pairs = self.listed(at_most(bins.groupBy("b").agg(F.sum("n").alias("n"), F.min("c").alias("c")), PAIRS)).select("k", "lp").toArrow()
        return self.head_words | {"k": pairs["k"].to_numpy(), "lp": pairs["lp"].to_numpy()}

    @property
    def buckets(self) -> int:
        return 1 << max(6, int(self.n // BUCKET).bit_length())


_indexed: list = []


def indexes(head: dict) -> list:
    """Hash indexes of a head's words and pairs; a worker keeps those of the last head."""
    import pandas as pd

    if not _indexed or _indexed[0] is not head:
        _indexed[:] = head, pd.Index(head["w"]), pd.Index(head["k"])
    return _indexed[1:]


SCORED = "uid long, held_out boolean, n_tokens long, known long, base double, score double, u long, w long, bucket int, window long, k binary, at binary, uids binary, kind int"
#: Values of kind: sums of texts, what goes by window, and from RARE on the slices of pairs with rarer words.
SUMS, WINDOWS, RARE = 0, 1, 2


def _score(sent, n: int, v: int, discount: float, buckets: int, part: int):
    """A mapInArrow function over (uid, held_out, text): sums of a slice's pairs as far as the head reaches, and all others.

    A row has the sums of a text, a pair (u, w) with a rarer word, the texts of a window (``uids``), or the pairs of a window in a
    bucket by ``k`` with their texts (``at``: place in the window, twice, and one more if held out); the sums have these as if no table did.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        head = sent.value
        words, pairs = indexes(head)
        base = np.log10((head["c"] + 0.5) / (n + 0.5 * (v + 1)))
        window = TaskContext.get().partitionId() << 32

        names, types = zip(*[x.split() for x in SCORED.split(", ")], strict=True)
        kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32(), "binary": pa.binary()}

        def out(size, **columns):
            """Rows with the columns given and nulls for the others."""
            return pa.RecordBatch.from_arrays([pa.array(columns[x], kinds[t]) if x in columns else pa.nulls(size, kinds[t]) for x, t in zip(names, types, strict=True)], names=list(names))

        uids, texts, asked, size = [], 0, [], 0

        def close():
            """The rows of the window."""
            yield out(1, window=[window], uids=packed(np.concatenate(uids), [texts]), kind=[WINDOWS])
            used, k, at = dealt(buckets, *(np.concatenate(x) for x in zip(*asked, strict=True)))
            yield out(len(used), bucket=used, window=np.full(len(used), window), k=k, at=at, kind=np.full(len(used), WINDOWS, np.int32))

        for whole in batches:
            for start in range(0, len(whole), 500):
                batch = whole.slice(start, 500)
                many, held = len(batch), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
                sums, tokens = np.zeros((3, many)), np.zeros(many, np.int64)
                for row, u, w in Reader(batch.column(2)):
                    tokens += np.bincount(row, minlength=many)
                    k = pair_hash(u, w)
                    mine = (k & (JOINED - 1)) == part
                    row, u, w, k = row[mine], u[mine], w[mine], k[mine]
                    iw, iu, ik = words.get_indexer(w), words.get_indexer(u), pairs.get_indexer(k)
                    hit = (iw >= 0) & (ik >= 0)
                    near = (iw >= 0) & ~hit & (iu >= 0)
                    here = hit | near
                    sums[0] += np.bincount(row[here], minlength=many)
                    sums[1] += np.bincount(row[here], base[iw[here]], minlength=many)
                    sums[2] += np.bincount(row[hit], head["lp"][ik[hit]], minlength=many)
                    of = row[near]
                    back, single = unlisted(head, iu[near], iw[near], discount)
                    sums[2] += np.bincount(of, np.log10(back + np.where(held[of], 0, single)), minlength=many)
                    asked.append((k[near], ((of + texts) * 2 + held[of]).astype(np.int32)))
                    size += len(of)
                    if not here.all():
                        far = pa.array(row[~here])
                        yield out(len(far), uid=batch.column(0).take(far), held_out=batch.column(1).take(far), u=u[~here], w=w[~here], kind=(RARE + (k[~here] & (FAR_JOINED - 1))).astype(np.int32))
                yield out(many, uid=batch.column(0), held_out=batch.column(1), n_tokens=tokens if part == 0 else np.zeros_like(tokens), known=sums[0].astype(np.int64), base=sums[1], score=sums[2], kind=np.full(many, SUMS, np.int32))
                uids.append(batch.column(0).to_numpy())
                texts += many
                if size > WINDOW or texts > WINDOW:
                    yield from close()
                    uids, texts, asked, size, window = [], 0, [], 0, window + 1
        if asked:
            yield from close()

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """Train on all texts outside the held-out fold and score all."""
    spark = docs.sparkSession
    with small_batches(spark), scope(spark) as keep:
        model = Model(docs)
        sent = spark.sparkContext.broadcast(model.head())
        dealt_pairs, others = model.near.select("bucket", "k", "train", "held"), model.far
        rows = docs.select(F.xxhash64("doc_id", "text").alias("uid"), "doc_id", (fold() == 1).alias("held_out"), "text")
        figures = [f"{x}{s}" for x in "bp" for s in model.sweeps]
        of = lambda side: model.words.select(F.col("w").alias(side), F.col("c").alias(f"{side}c"), *[F.col(f"{x}{s}").alias(f"{side}{x}{s}") for x in ("b" if side == "u" else "p") for s in model.sweeps])
        base = F.log10((F.coalesce("wc", F.lit(0)) + 0.5) / F.lit(model.n + 0.5 * (model.v + 1)))
        back = sum((F.coalesce(f"ub{s}", F.lit(1.0)) * F.coalesce(f"wp{s}", F.lit(model.unseen[s - 1])) for s in model.sweeps), F.lit(0.0)) / model.kept
        single = (1 - model.discount) / (STRENGTH + F.coalesce("uc", F.lit(0)))
        found = []
        for part in range(JOINED):
            here = rows.select("uid", "held_out", "text").mapInArrow(_score(sent, model.n, model.v, model.discount, model.buckets, part), SCORED)
            with folders_by(spark, "kind", 2 + FAR_JOINED):
                here = materialize(here, "asked")
            # What the pairs asked for add, by window and then by text.
            asks = here.filter(F.col("kind") == WINDOWS).filter("bucket is not null").select("bucket", "window", "k", "at").groupBy("bucket")
            gains = asks.cogroup(dealt_pairs.filter(F.col("bucket").bitwiseAND(JOINED - 1) == part).groupBy("bucket")).applyInArrow(_answered, "window long, at binary, gain binary")
            gains = gains.unionByName(here.filter(F.col("kind") == WINDOWS).filter("uids is not null").select("window", "uids"), allowMissingColumns=True).groupBy("window").applyInArrow(_returned, "uid long, score double")
            found.append(materialize(gains, "gains"))
            own = here.filter(F.col("kind") == SUMS).select("uid", "n_tokens", "known", "base", "score")
            found.append(materialize(own.groupBy("uid").agg(*[F.sum(x).alias(x) for x in own.columns[1:]]), "sums"))
            for slice in range(part, FAR_JOINED, JOINED):
                rare = here.filter(F.col("kind") == RARE + slice)
                far = rare.select("uid", "held_out", "u", "w").join(of("w").hint("shuffle_hash"), "w", "left").join(of("u").hint("shuffle_hash"), "u", "left")
                far = far.select("uid", F.xxhash64("u", "w").alias("k"), F.log10(back + F.when(F.col("held_out"), 0.0).otherwise(single)).alias("alt"), F.log10(back + single).alias("one"), F.col("wc").isNotNull().cast("long").alias("known"), base.alias("base"))
                far = far.join(others.filter(F.col("k").bitwiseAND(FAR_JOINED - 1) == slice).hint("shuffle_hash"), "k", "left")
                score = F.coalesce("lp", F.when(F.col("c") == 1, F.coalesce("one", "alt")), "alt")
                found.append(materialize(far.groupBy("uid").agg(F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum(score).alias("score")), "sums"))
            discard(here)
        # Rows that share doc_id and text were added up: each has its part.
        listed = keep(materialize(rows.select("uid", "doc_id", "held_out"), "listed"))
        totals = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found).groupBy("uid").agg(*[F.sum(x).alias(x) for x in ("n_tokens", "known", "base", "score")])
        times = listed.groupBy("uid").agg(F.count("*").alias("m"))
        totals = keep(materialize(totals.join(times, "uid"), "totals"))
    out = listed.join(totals, "uid")
    share = lambda x: F.col(x) / F.col("m")
    return out.select(
        "doc_id", "held_out", F.round(share("n_tokens")).cast("long").alias("n_tokens"), F.round(share("known")).cast("long").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        share("base").alias("base_score"), share("score").alias("score"), F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def op8_language_model(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_language_model": op8_language_model}
SQL: dict[str, str] = {}
