"""Cost-balanced packing of documents into sequences of at most 4096 tokens.

A sequence costs ``linear * tokens + quadratic * sum(piece length squared)``: attention stays inside a
piece.  Each task packs what it reads, in runs of about four million tokens, so nothing is shuffled and
memory is bounded by one run (and its longest document).  In a run, whole blocks of 4096 tokens are cut
off long documents; the rests go in descending length to the cheapest of all sequences with room for the
whole piece, found in an index by room; only if there is none, the piece is cut at the room of the cheapest.  A run
opens exactly as many places as it has tokens: full sequences, then powers of two for the remainder,
so no sequence needs padding.

Word ids come from ``tokenizers`` and are kept by space-delimited chunk.  That is exact: the tokenizer
drops white space, and neither its normalization nor its split reaches across a space.

Defined cases: null and empty texts hold the end id alone; ids, nulls and repeated rows in ``doc_id``
are carried as they are, each row packed on its own; an empty table gives an empty result; other
columns are ignored.  ``sequence_id`` is unique in the result (task number and a counter).
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from unicodedata import is_normalized

from pyspark.sql import DataFrame

LIMIT = 4096
END_ID = 2
RUN_TOKENS = 4_000_000
CACHE_WORDS = 1_000_000
TEXTS = 128
LINEAR, QUADRATIC = 2048.0, 1.0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_encoders: dict[str, WordEncoder] = {}


#: A chunk of letters with ASCII marks behind them.
LETTERS = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary: themselves where printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


class WordEncoder:
    """Little-endian unsigned 32-bit ids of texts, with a bounded cache by chunk.

    The tokenizer splits at every change between letters and other characters, so a chunk of letters with
    marks behind it is the letters' ids and the marks'.  Letters of the older scripts (below U+0530) that
    are normalized need no split: lower-cased, their bytes go straight to its model.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.marks: dict[str, bytes] = {"": b""}
        self.letters = byte_letters()

    @classmethod
    def at(cls, path: str) -> WordEncoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def direct(self, chunks: list[str]) -> list[bytes]:
        return [array("I", got.ids).tobytes() for got in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def learn(self, chunks: list[str]) -> None:
        """Add the ids of new chunks to the cache."""
        known, tokenize, marks, whole = self.known, self.tokenizer.model.tokenize, self.marks, []
        for chunk in chunks:
            found = LETTERS.fullmatch(chunk)
            if not found:
                whole.append(chunk)
                continue
            core, tail = found.groups()
            if core.isascii():
                low = bytes_ = core.lower()
            elif max(core) < "\u0530" and is_normalized("NFC", core):
                low = "".join([c.lower() for c in core])
                bytes_ = low.encode().decode("latin-1").translate(self.letters)
            else:
                low = ""
            if not low.isalpha() or not core.isalpha():
                whole.append(chunk)
                continue
            if low not in known:
                known[low] = array("I", [t.id for t in tokenize(bytes_)]).tobytes()
            if tail not in marks:
                marks[tail] = self.direct([tail])[0]
            if chunk is not low:
                known[chunk] = known[low] + marks[tail]
        known.update(zip(whole, self.direct(whole), strict=True))
        if len(marks) > 10_000:
            self.marks = {"": b""}

    def encode(self, texts: list[str]) -> list[bytes]:
        words = [text.replace("\n", " ").split(" ") for text in texts]
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
            known[""] = b""
        self.learn([w for w in set().union(*words) if w not in known])
        return [b"".join(map(known.__getitem__, x)) for x in words]


class Rooms:
    """Open sequences by remaining room: a heap by cost for each room, below a tree of minima."""

    def __init__(self, limit: int):
        self.size = 1 << limit.bit_length()
        self.none = (float("inf"), 1 << 62, 0)
        self.tree = [self.none] * (2 * self.size)
        self.heaps: list[list[tuple[float, int, int]]] = [[] for _ in range(limit + 1)]

    def _climb(self, room: int) -> None:
        tree, at = self.tree, self.size + room
        tree[at] = self.heaps[room][0] if self.heaps[room] else self.none
        while at > 1:
            at >>= 1
            tree[at] = min(tree[2 * at], tree[2 * at + 1])

    def put(self, cost: float, i: int, room: int) -> None:
        heapq.heappush(self.heaps[room], (cost, i, room))
        if self.heaps[room][0][1] == i:
            self._climb(room)

    def take(self, least: int) -> tuple[float, int, int] | None:
        """Remove the cheapest sequence with room for ``least`` tokens."""
        tree, best, lo, hi = self.tree, self.none, self.size + least, 2 * self.size
        while lo < hi:
            if lo & 1:
                best = min(best, tree[lo])
                lo += 1
            lo >>= 1
            hi >>= 1
        if not best[2]:
            return None
        heapq.heappop(self.heaps[best[2]])
        self._climb(best[2])
        return best


def pack(lengths: list[int], limit: int = LIMIT, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) of one run, and the number of sequences."""
    pieces, n_sequences, rests = [], 0, []
    for d, n in enumerate(lengths):
        start = 0
        while n - start >= limit:
            pieces.append((d, start, limit, n_sequences, 0))
            n_sequences += 1
            start += limit
        if n > start:
            rests.append((start - n, d, start))
    left = -sum(r[0] for r in rests)
    rooms = [limit] * (left // limit) + [1 << k for k in range(limit.bit_length() - 1, -1, -1) if left % limit >> k & 1]
    used = [0] * len(rooms)
    # Full sequences first; the short ones take what is cut off in the end.
    free = Rooms(limit)
    for i, room in enumerate(rooms):
        free.put(0.0 if room == limit else float("inf"), i, room)
    heapq.heapify(rests)
    while rests:
        minus, d, start = heapq.heappop(rests)
        n = -minus
        cost, i, room = free.take(n) or free.take(1)
        part = min(n, room)
        pieces.append((d, start, part, n_sequences + i, used[i]))
        used[i] += part
        if part < room:
            free.put(cost + linear * part + quadratic * part * part, i, room - part)
        if part < n:
            heapq.heappush(rests, (part - n, d, start + part))
    return pieces, n_sequences + len(rooms)


def packer(path: str, limit: int = LIMIT, run_tokens: int = RUN_TOKENS):
    """A mapInArrow function over (doc_id, text)."""

    def run(batches: Iterator) -> Iterator:
        import os

        import pyarrow as pa
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = WordEncoder.at(path)
        end = END_ID.to_bytes(4, "little")
        types = [("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]]
        first = TaskContext.get().partitionId() << 40
        ids: list = []
        coded: list[bytes] = []
        held = 0

        def flush():
            nonlocal first, held
            pieces, n = pack([len(x) // 4 for x in coded], limit)
            rows = [(ids[d], s, k, zlib.crc32(memoryview(coded[d])[4 * s : 4 * (s + k)]), len(coded[d]) // 4, first + q, o) for d, s, k, q, o in pieces]
            first += n
            ids.clear()
            coded.clear()
            held = 0
            for i in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows[i : i + 50_000], strict=True), types, strict=True)], names=[x for x, _ in types])

        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part = batch.slice(at, TEXTS)
                texts = [x or "" for x in part.column(1).to_pylist()]
                for doc_id, got in zip(part.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    ids.append(doc_id)
                    coded.append(got + end)
                    held += len(coded[-1]) // 4
                    if held >= run_tokens:
                        yield from flush()
        if ids:
            yield from flush()

    return run


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per piece of every document."""
    return docs.select("doc_id", "text").mapInArrow(packer(path or tokenizer_path()), SCHEMA)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_packing": op9_packing}
SQL: dict[str, str] = {}
