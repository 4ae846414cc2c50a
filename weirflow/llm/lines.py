"""Fuzzy line dedup by MinHash.

A line (between line feeds, with a character that is not white space) is the set of its shingles of
eight characters; a shorter line is one shingle.  One permutation hashing spreads the shingles over
BANDS * ROWS bins and keeps 16 bits of the least of each; an empty bin borrows from the next.  A band of
bins is a bucket key.  At Jaccard 0.8, ten bands of four find 99.5 % of the pairs.

Every line of a bucket is first compared with the bucket's least line (exact Jaccard on the texts must reach
0.8); those links are contracted by the distributed union-find.  Then only buckets that still hold several
components are looked at again, and in them only pairs of different components, inside sorted partitions.
A bucket of over ``BLOCK`` lines is cut: the lines of the least line's component are dealt over blocks once and
the others are sent to each block, so a template on any number of lines costs rows in proportion to
them; the others among themselves go block against block.  A pair is looked at in its first common band only, and pairs
that are connected already are passed over.  Equal lines count as one line throughout.  Of
every component the first line stays, by (doc_id, text hash, line number).

The plan is the same at every size: nothing is broadcast by this module, all joins are left to Spark; the texts of
lines are shuffled once, those of documents once.

A line is identified by its 64-bit XXH64.  Defined cases: null and blank texts have no lines; blank
lines always stay; rows that share doc_id and text are one document and share their outcome; null ids
sort first; an empty table gives an empty result; other columns pass through (working columns start
with ``__l``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.durable import columns, discard, materialize, scope
from weirflow.llm.components import components

CHARS, BANDS, ROWS, SIMILAR = 8, 10, 4, (4, 5)
SEED = 42
PIECE = 250_000
SEEN = 500_000
BLOCK = 500
#: Shingles that a task remembers, eight bytes each.
HELD = 4_000_000
LINES = "doc_id {id}, th long, n_lines int, no array<int>, h array<long>, fh array<long>, sigs array<binary>"


def shingles(codes):
    """Hashes of all windows of CHARS code points (uint64 array)."""
    import numpy as np

    with np.errstate(over="ignore"):
        x, p, k = codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15), 0x100000001B3, 1
        while k < CHARS:
            x = x[:-k] * np.uint64(pow(p, k, 1 << 64)) + x[k:]
            k *= 2
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
    return x


def signatures(codes, starts, ends):
    """Signatures (lines, BANDS * ROWS) of 16 bits of the lines codes[start:end], by one permutation hashing."""
    import numpy as np

    n, bins = len(starts), BANDS * ROWS
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    sig = np.full((n, bins), none, np.uint64)
    length = ends - starts
    if len(codes) >= CHARS:
        hashes = shingles(codes)
        owner = np.repeat(np.arange(n), np.maximum(length - CHARS + 1, 0))
        first = np.repeat(starts - np.concatenate(([0], np.cumsum(np.maximum(length - CHARS + 1, 0))[:-1])), np.maximum(length - CHARS + 1, 0))
        h = hashes[np.arange(len(owner)) + first]
        place = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
        np.minimum.at(sig.reshape(-1), owner * bins + place.astype(np.int64), h)
    with np.errstate(over="ignore"):
        for i in np.flatnonzero(length < CHARS):  # a short line is one shingle
            x = np.uint64(length[i])
            for c in codes[starts[i] : ends[i]]:
                x = x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c) + np.uint64(1)
            sig[i, int(x >> np.uint64(32)) % bins] = x
        step = np.uint64(0xD6E8FEB86659FD93)
        empty = sig == none
        source, far = sig, 0
        while empty.any():
            far += 1
            source = np.roll(source, -1, axis=1)
            filled = empty & (source != none)
            sig = np.where(filled, source + step * np.uint64(far), sig)
            empty &= ~filled
    return (sig >> np.uint64(16)).astype(np.uint16)


def signatures_of(lines: list[str]):
    """Signatures of lines, made by pieces."""
    import numpy as np

    out, at = [], 0
    while at < len(lines):
        end, chars = at, 0
        while end < len(lines) and chars < PIECE:
            chars += len(lines[end])
            end += 1
        length = np.fromiter(map(len, lines[at:end]), np.int64, end - at)
        starts = np.cumsum(length + 1) - length - 1
        out.append(signatures(np.frombuffer("\n".join(lines[at:end]).encode("utf-32-le", "surrogatepass"), np.uint32), starts, starts + length))
        at = end
    return np.concatenate(out)


def _split(batches: Iterator) -> Iterator:
    """(doc_id, text) to one row per document with its lines' hashes, and signatures of lines new to this task."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    seen: set[int] = set()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    lists = lambda values, sizes, kind: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, kind))

    def rows(ids, texts):
        no, hs, fh, size, own, new, where, part = [], [], [], [], [], [], [], 0
        ths = []
        for text in texts:
            raw = text.encode("utf-8", "surrogatepass")
            ths.append(signed(xxhash.xxh64_intdigest(raw, SEED)))
            at, count, fresh = part, 0, 0
            for k, (line, bare) in enumerate(zip(text.split("\n"), raw.split(b"\n"), strict=True)):
                if bare.strip():
                    h = signed(xxhash.xxh64_intdigest(bare, SEED))
                    no.append(k)
                    hs.append(h)
                    count += 1
                    if h not in seen:
                        seen.add(h)
                        fh.append(h)
                        size.append(len(line))
                        where.append(at)
                        fresh += 1
                at += len(line) + 1
            part += len(text) + 1
            own.append(count)
            new.append(fresh)
        codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.array(where, np.int64)
        sigs = signatures(codes, starts, starts + np.array(size, np.int64)) if where else np.zeros((0, BANDS * ROWS), np.uint16)
        blobs = pa.Array.from_buffers(pa.binary(2 * BANDS * ROWS), len(fh), [None, pa.py_buffer(sigs.tobytes())]).cast(pa.binary())
        blobs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(new))), pa.int32()), blobs)
        columns = [ids, pa.array(ths, pa.int64()), pa.array(own, pa.int32()), lists(no, own, pa.int32()), lists(hs, own, pa.int64()), lists(fh, new, pa.int64()), blobs]
        if len(seen) > SEEN:
            seen.clear()
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "n_lines", "no", "h", "fh", "sigs"])

    for batch in batches:
        texts = [x.as_py() or "" for x in batch.column(1)]
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (chars < PIECE):
                chars += len(texts[end])
                end += 1
            yield rows(batch.column(0).slice(at, end - at), texts[at:end])
            at = end


def cut(line: str) -> frozenset[str]:
    """The shingles of a line."""
    return frozenset(line[i : i + CHARS] for i in range(max(1, len(line) - CHARS + 1)))


def numbers(line: str) -> frozenset:
    """The same with eight characters up to U+00FF as the number that their bytes make."""
    import numpy as np

    if len(line) < CHARS:
        return frozenset((line,))
    try:
        raw = line.encode("latin-1")
    except UnicodeEncodeError:
        return frozenset(int.from_bytes(x.encode("latin-1"), "little") if max(x) < "\u0100" else x for x in cut(line))
    return frozenset(np.ndarray((len(raw) - CHARS + 1,), "<u8", raw, strides=(1,)).tolist())


def similar(x: frozenset, y: frozenset) -> bool:
    """Exact Jaccard against SIMILAR; sets whose sizes alone are too far apart are not intersected."""
    small, large = (len(x), len(y)) if len(x) < len(y) else (len(y), len(x))
    if small * SIMILAR[1] < large * SIMILAR[0]:
        return False
    common = len(x & y)
    return common * SIMILAR[1] >= (len(x) + len(y) - common) * SIMILAR[0]


class Shingled:
    """Shingles of lines by hash as sorted numbers, which are exact; forgets all when they are over HELD.

    Those of :func:`numbers` from 2**56 stand for themselves.  Any other shingle gets the next number below when it is first met.
    """

    def __init__(self):
        self.held, self.named, self.size = {}, {}, 0

    def of(self, h: int, line: str):
        import numpy as np

        found = self.held.get(h)
        if found is None:
            try:
                raw = line.encode("latin-1") if len(line) >= CHARS and "\0" not in line else b""
            except UnicodeEncodeError:
                raw = b""
            if raw:
                found = np.ndarray((len(raw) - CHARS + 1,), "<u8", raw, strides=(1,)).copy()
            else:
                found = np.array([x if isinstance(x, int) and x >> 56 else self.named.setdefault(x, len(self.named)) for x in numbers(line)], np.uint64)
            found.sort()
            new = found[1:] != found[:-1]
            if not new.all():
                found = found[np.concatenate(([True], new))]
            self.held[h] = found
            self.size += len(found)
        return found

    def similar(self, i: int, x: str, j: int, y: str) -> bool:
        """Whether the exact Jaccard of lines x and y with hashes i and j reaches SIMILAR, as :func:`similar` has it."""
        import numpy as np

        if self.size > HELD:  # not between the two, as numbers are given anew
            self.held, self.named, self.size = {}, {}, 0
        a, b = self.of(i, x), self.of(j, y)
        small, large = (len(a), len(b)) if len(a) < len(b) else (len(b), len(a))
        if small * SIMILAR[1] < large * SIMILAR[0]:
            return False
        both = np.concatenate((a, b))
        both.sort(kind="stable")  # two sorted runs are merged
        common = int(np.count_nonzero(both[1:] == both[:-1]))
        return common * SIMILAR[1] >= (small + large - common) * SIMILAR[0]


def _verify(batches: Iterator) -> Iterator:
    """The pairs (a, b) among rows (a, b, x, y) whose lines x and y are similar."""
    import pyarrow as pa

    shingled = Shingled()
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keep = [shingled.similar(i, x, j, y) for i, j, x, y in zip(a, b, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def forest(band: int, side, hashes, comps, sigs, line_at, shingled: Shingled) -> list[tuple[int, int]]:
    """Links that connect the components of one bucket, from the pairs of sides 0 and 1 whose first common band is this.

    ``side`` is 0, 1 or 2; lines of side 2 are compared with all.
    """
    import numpy as np

    parent = {c: c for c in comps}

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    links, names = [], hashes.tolist()
    bands = np.ascontiguousarray(sigs).view(np.uint64)  # ROWS times 16 bits
    for i in range(len(hashes) - 1):
        open_ = (comps[i + 1 :] != comps[i]) & ((side[i + 1 :] != side[i]) | (side[i] == 2))
        at = np.flatnonzero(open_) + i + 1
        first = (bands[at] == bands[i]).argmax(axis=1)
        for j in at[first == band].tolist():
            if (a := root(comps[i])) == (b := root(comps[j])):
                continue
            if shingled.similar(names[i], line_at(i), names[j], line_at(j)):
                parent[b] = a
                links.append((int(comps[i]), int(comps[j])))
    return links


def _compare(batches: Iterator) -> Iterator:
    """Links of components from rows (band, key, part, side, h, c, line), those of a bucket's part together."""
    import numpy as np
    import pyarrow as pa

    shingled, held = Shingled(), None

    def finished(rows, last):
        """Links of all parts of ``rows``, and the rows of the last one if it may go on."""
        key = np.stack([rows[c].to_numpy() for c in ("key", "part")])
        bounds = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()]
        if last:
            bounds.append(len(rows))
        done, found = rows.slice(0, bounds[-1]).combine_chunks(), []
        if len(done):
            band, side, h, c = (done[x].to_numpy() for x in ("band", "side", "h", "c"))
            lines = done["line"].to_pylist()
            sigs = signatures_of(lines)
            for i, j in zip(bounds, bounds[1:], strict=False):
                found += forest(band[i], side[i:j], h[i:j], c[i:j], sigs[i:j], lambda k, i=i: lines[i + k], shingled)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"]), rows.slice(bounds[-1])

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        out, held = finished(rows, False)
        yield out
    if held is not None and len(held):
        yield finished(held, True)[0]


def parted(members: DataFrame) -> DataFrame:
    """Rows (band, key, part, side, h, c) to compare, from (band, key, pivot, h, c): buckets of several components.

    The pivots have been compared with all of their buckets, so only the other lines are left.
    """
    other = F.when(F.col("h") != F.col("pivot"), F.col("c"))
    keys = members.groupBy("key").agg(F.max(F.when(F.col("h") == F.col("pivot"), F.col("c"))).alias("main"), F.min(other).alias("least"), F.max(other).alias("most"))
    # Written, so that a hot bucket's rows may be split in the joins.
    keys = materialize(keys.filter("least < most").select("key", "main"), "open_keys")
    mine = materialize(members.filter("h <> pivot").join(keys, "key").withColumn("inner", F.col("c") == F.col("main")), "open_members")
    blocks = lambda flag: F.ceil(F.count(F.when(flag, 1)) / BLOCK).cast("int")
    sizes = mine.groupBy("key").agg(F.count("*").alias("n"), blocks(F.col("inner")).alias("bi"), blocks(~F.col("inner")).alias("bo"))
    rows = mine.join(materialize(sizes, "sizes"), "key").withColumn("own", F.pmod(F.xxhash64("h"), F.when(F.col("inner"), F.col("bi")).otherwise(F.col("bo"))).cast("long"))
    part = lambda kind, i, j: F.struct((F.lit(kind).cast("long") * (1 << 60) + i * (1 << 30) + j).alias("part"))
    every = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(F.array().cast("array<struct<part:bigint>>"))
    own = F.col("own")
    # 0: a small bucket whole; 1: a block of the main component with one of the others; 2: the others among themselves.
    others = F.concat(every(F.col("bi"), lambda i: part(1, i.cast("long"), own)), every(F.col("bo"), lambda j: part(2, F.least(own, j.cast("long")), F.greatest(own, j.cast("long")))))
    to = F.when(F.col("n") <= BLOCK, F.array(part(0, F.lit(0).cast("long"), F.lit(0).cast("long")))).when(F.col("inner"), every(F.col("bo"), lambda j: part(1, own, j.cast("long")))).otherwise(others)
    rows = rows.withColumn("part", F.explode(to)).withColumn("part", F.col("part.part"))
    kind, i, j = F.shiftright("part", 60), F.shiftright(F.col("part").bitwiseAND((1 << 60) - 1), 30), F.col("part").bitwiseAND((1 << 30) - 1)
    side = F.when(kind == 0, 2).when(kind == 1, F.col("inner").cast("int")).when(i == j, 2).otherwise((own == j).cast("int"))
    return rows.select("band", "key", "part", side.alias("side"), "h", "c")


def link(table: DataFrame, docs: DataFrame) -> DataFrame:
    """(h, c): lines that are similar to others, and the component they are in."""
    spark = docs.sparkSession
    with scope(spark) as keep:
        lines_ = table.select(F.explode(F.arrays_zip("fh", "sigs")).alias("x")).select(F.col("x.fh").alias("h"), F.col("x.sigs").alias("sig"))
        bands = F.array(*[F.struct(F.lit(j).alias("band"), F.xxhash64(F.lit(j), F.substring("sig", 2 * ROWS * j + 1, 2 * ROWS)).alias("key")) for j in range(BANDS)])
        rows = lines_.select("h", F.explode(bands).alias("x")).select("x.band", "x.key", "h")
        pivots = materialize(rows.groupBy("key").agg(F.min("h").alias("pivot"), F.max("h").alias("top")).filter("pivot < top").select("key", "pivot"), "pivots")
        members = materialize(rows.join(pivots.hint("shuffle_hash"), "key").distinct(), "members")
        wanted = members.select("h").distinct()
        texts = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).select(F.xxhash64("line").alias("h"), "line")
        # Written before it is summed up, so that a line that is everywhere may be split in the join.
        known = materialize(texts.join(wanted.hint("shuffle_hash"), "h", "left_semi"), "wanted_lines")
        line = materialize(known.groupBy("h").agg(F.max("line").alias("line")), "known_lines")
        discard(known)
        stars = members.filter("h <> pivot").select(F.col("pivot").alias("a"), F.col("h").alias("b")).distinct()
        # The last join leaves the pairs of a pivot together, so its shingles are made once.
        stars = stars.join(line.withColumnsRenamed({"h": "b", "line": "y"}), "b").join(line.withColumnsRenamed({"h": "a", "line": "x"}), "a")
        first = components(stars.select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long"))
        placed = members.join(first.withColumnsRenamed({"node": "h", "root": "c"}), "h", "left").withColumn("c", F.coalesce("c", "h"))
        full = parted(materialize(placed, "placed")).join(line, "h").select("band", "key", "part", "side", "h", "c", "line")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        dealt = full.repartition(parts, "key", "part").sortWithinPartitions("key", "part")
        second = components(dealt.mapInArrow(_compare, "a long, b long"))
        nodes = first.select(F.col("node").alias("h"), F.col("root").alias("c")).union(second.select(F.col("node").alias("h"), F.col("node").alias("c"))).groupBy("h").agg(F.min("c").alias("c"))
        linked = nodes.join(second.withColumnsRenamed({"node": "c", "root": "far"}), "c", "left").select("h", F.coalesce("far", "c").alias("c"))
        return keep(materialize(linked, "line_components"))


def drops(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written table of documents and lines, and (doc_id, th, drop): the line numbers to drop."""
    kind = dict(docs.dtypes)["doc_id"]
    with scope(docs.sparkSession) as keep:
        table = keep(materialize(docs.select("doc_id", "text").mapInArrow(_split, LINES.format(id=kind)), "lines"))
        linked = link(table, docs)
        occurs = table.select("doc_id", "th", F.explode(F.arrays_zip("no", "h")).alias("x")).select("doc_id", "th", "x.no", "x.h")
        classed = materialize(occurs.join(linked, "h", "left").withColumn("c", F.coalesce("c", "h")).drop("h"), "classed")
        here = F.struct("doc_id", "th", "no")
        first = classed.groupBy("c").agg(F.min(here).alias("first"), F.max(here).alias("end")).filter("first < end").select("c", "first")
        gone = classed.join(materialize(first, "first_lines"), "c").filter(here > F.col("first"))
        return table, keep(materialize(gone.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("no")).alias("drop")), "drops"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents without the repeated lines; ``n_chars`` follows the text where it exists."""
    with scope(docs.sparkSession) as keep:
        gone = keep(drops(docs)[1])
    gone = gone.select(F.col("doc_id").alias("__l_rid"), F.col("th").alias("__l_rth"), F.col("drop").alias("__l_drop"))
    rows = docs.withColumn("__l_th", F.xxhash64(F.coalesce("text", F.lit(""))))
    # The hint keeps the plan of large tables for small ones.
    joined = rows.join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__l_rid")) & (F.col("__l_th") == F.col("__l_rth")), "left")
    rest = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("__l_drop", i)), "\n")
    out = joined.withColumn("text", F.when(F.col("__l_drop").isNull(), F.col("text")).otherwise(rest))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__l_drop").isNull(), F.col("n_chars")).otherwise(F.length("text")))
    return out.select(*columns(docs))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    table, gone = drops(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    gone = gone.select(F.col("doc_id").alias("r_id"), F.col("th").alias("r_th"), "drop")
    rows = table.select("doc_id", "th", "n_lines").join(gone, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("th") == F.col("r_th")), "left")
    lost = F.coalesce(F.size("drop"), F.lit(0))
    return rows.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), (F.col("n_lines") - F.greatest(lost, F.lit(0))).cast("long").alias("n_kept"), F.coalesce(F.array_join(F.col("drop").cast("array<string>"), ","), F.lit("")).alias("dropped_lines"))


QUERIES = {"op10_line_dedup": op10_line_dedup}
SQL: dict[str, str] = {}
