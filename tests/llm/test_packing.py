"""Packing: an exact round trip of the ids, and the shape of sequences."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from weirflow.llm import packing

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def direct():
    return tokenizers.Tokenizer.from_file(packing.tokenizer_path())


def ids_of(direct, text):
    return [*direct.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def check(rows, texts, direct):
    """Every id in one piece, pieces gapless, sequences full or a power of two."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        ids, at = ids_of(direct, texts[d]), 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and (at == 4096 or at & (at - 1) == 0)


def test_round_trip(spark, sf_dir, direct):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(packing.op9_packing(spark, sf_dir).collect(), {r.doc_id: r.text for r in docs.collect()}, direct)


def pack_by_force(lengths, limit):
    """Each rest to the cheapest sequence with room for it, over all sequences; cut only if there is none."""
    rests = sorted(((n % limit, d, n - n % limit) for d, n in enumerate(lengths) if n % limit), key=lambda x: (-x[0], x[1], x[2]))
    left, first = sum(r[0] for r in rests), sum(n // limit for n in lengths)
    rooms = [limit] * (left // limit) + [1 << k for k in range(limit.bit_length() - 1, -1, -1) if left % limit >> k & 1]
    cost, got = [0.0 if r == limit else float("inf") for r in rooms], []
    while rests:
        n, d, start = rests.pop(0)
        i = min([i for i, r in enumerate(rooms) if r >= n] or [i for i, r in enumerate(rooms) if r], key=lambda i: (cost[i], i))
        part = min(n, rooms[i])
        got.append((d, start, part, first + i))
        rooms[i] -= part
        cost[i] += packing.LINEAR * part + packing.QUADRATIC * part * part
        if part < n:
            rests = sorted([*rests, (n - part, d, start + part)], key=lambda x: (-x[0], x[1], x[2]))
    return got


@pytest.mark.parametrize("seed", range(5))
def test_a_rest_is_cut_only_if_no_sequence_has_room(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randrange(1, 40), rng.randrange(1, 257), rng.randrange(1, 900)]) for _ in range(600)]
    pieces, _ = packing.pack(lengths, 256)
    assert [x[:4] for x in pieces if x[2] < 256] == [x for x in pack_by_force(lengths, 256) if x[2] < 256]


def test_odd_texts(spark, direct):
    texts = {
        1: None, 2: "", 3: "  \n\t ", 4: "It's 12 Cafés,　don't!\x1cStop <|endoftext|> a<|startoftext|>b", 5: "ΑΣ ΟΔΟΣ Straße İstanbul é ́x",
        6: "word " * 9000, 7: "x" * 5000, 8: "​ \x85 \x0b\x0c", 9: "emoji 👩‍👩‍👧 and ½ ①",
    }
    rows = packing.pack_documents(spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, length string")).collect()
    check(rows, texts, direct)


def test_chunks_by_hypothesis(direct):
    """Any text over scripts, marks, spaces and special strings encodes as the tokenizer does it."""
    from hypothesis import given, settings
    from hypothesis import strategies as st

    encoder = packing.WordEncoder.at(packing.tokenizer_path())
    letters = st.text("aZsStTeéÉüßİıΣσςЖжʼnªºāĀ\u0301\u0345\u0958ǅ中½²٣19_'’.,!*%<|>@\x1c\x85\u00a0\u2003\t\n \r", max_size=30)
    special = st.sampled_from(["<|endoftext|>", "it's", "we'RE", "don't.", "word***", "ΑΣ.", "e\u0301,", "ﬁn", "Å", "Å."])

    @settings(max_examples=1500, deadline=None)
    @given(st.lists(st.one_of(letters, special, st.text(max_size=8)), max_size=6).map("".join))
    def run(text):
        try:
            text.encode()
        except UnicodeEncodeError:
            return
        assert list(np.frombuffer(encoder.encode([text])[0], "<u4")) == direct.encode(text, add_special_tokens=False).ids

    run()


def test_nulls_and_repeats(spark):
    rows = packing.pack_documents(spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 1), (0, 2), (1, 3), (1, 3)] or sum(r.length for r in rows) == 9
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_pack(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 7, 300, 4095, 4096, 4097, 9000, rng.randrange(1, 6000)]) for _ in range(rng.randrange(1, 300))]
    pieces, n = packing.pack(lengths)
    room = defaultdict(int)
    seen = defaultdict(list)
    for d, s, k, q, o in pieces:
        assert k > 0 and 0 <= q < n
        room[q] += k
        seen[d].append((s, k))
    assert all(x == 4096 or x & (x - 1) == 0 for x in room.values()) and len(room) == n
    for d, length in enumerate(lengths):
        at = 0
        for s, k in sorted(seen[d]):
            assert s == at
            at += k
        assert at == length


def test_costs_are_balanced():
    rng = random.Random(1)
    lengths = [rng.randrange(50, 3000) for _ in range(2000)]
    pieces, n = packing.pack(lengths)
    cost, size, cuts = defaultdict(float), defaultdict(int), len(pieces) - len(lengths)
    for _, _, k, q, _ in pieces:
        cost[q] += packing.LINEAR * k + packing.QUADRATIC * k * k
        size[q] += k
    full = [cost[q] for q in cost if size[q] == 4096]
    naive, at = defaultdict(float), 0
    for x in lengths:  # documents one after the other
        while x:
            k = min(x, 4096 - at % 4096)
            naive[at // 4096] += packing.LINEAR * k + packing.QUADRATIC * k * k
            at += k
            x -= k
    assert np.std(full) < 0.8 * np.std(list(naive.values())) and cuts < len(lengths)


def test_runs_bound_memory(spark, monkeypatch):
    run = packing.packer(packing.tokenizer_path(), run_tokens=50)
    rows = spark.createDataFrame([(i, "some words of text " * 5) for i in range(40)], "doc_id long, text string").coalesce(1).mapInArrow(run, packing.SCHEMA).collect()
    assert len({r.sequence_id for r in rows}) > 20 and sum(r.length for r in rows) == sum({r.doc_id: r.doc_tokens for r in rows}.values())
