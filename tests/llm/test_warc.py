"""Archives: an exact round trip, and salvage of damaged files."""

import hashlib
import random

import pytest

from weirflow.durable import new_path
from weirflow.llm import warc


def page(i, body, uri="http://h/p"):
    raw = body.encode()
    return warc.record(i, uri, raw, len(raw), hashlib.sha1(raw).hexdigest(), None)


def got(data):
    return [(k, s, e, x["fields"].get("x-page-id") if k == "record" else x) for k, s, e, x in warc.salvage(data)]


def test_query(same):
    same(warc.op1_warc, warc.SQL["op1_warc"])


def test_round_trip_of_odd_pages(spark):
    long = "x" * 1000
    rows = [(1, "http://a", long), (5, "u\r\nv: w", long), (3, None, long), (2, "", "short"), (4, "http://b", "short"), (7, "http://c", None), (None, "http://d", long + "y"), (8, "http://é", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\x1f\u008b" * 60), (9, "z", "ü" * 700_000)]
    path = new_path(spark, "test_archives")
    warc.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumnRenamed("x", "y"), path)
    read = warc.read_archives(spark, path).collect()
    assert all(r.kind == "record" for r in read) and len(read) == len(rows)
    by = {r.page_id: r for r in read}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (by[i].payload_bytes, by[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert by[i].record_type == "revisit" or bytes(by[i].payload) == raw
    assert {i: (by[i].record_type, by[i].refers_to) for i in (1, 3, 5, 2, 4, None)} == {1: ("revisit", 5), 3: ("revisit", 5), 5: ("response", None), 2: ("response", None), 4: ("response", None), None: ("response", None)}
    path = new_path(spark, "test_archives")
    warc.write_pages(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def test_members_end_with_a_zero_byte():
    import gzip

    big = random.Random(1).randbytes(20 << 20)
    for data in (b"", b"abc", big):
        packed = warc.member(data)
        assert packed[-1] == 0 and gzip.decompress(packed) == data


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage(zipped):
    parts = [warc.member(x) if zipped else x for x in (page(i, f"<p>page {i}</p>" * 50) for i in range(6))]
    whole, at = b"".join(parts), [0]
    for p in parts:
        at.append(at[-1] + len(p))
    assert got(whole) == [("record", at[i], at[i + 1], str(i)) for i in range(6)]
    broken = bytearray(whole)
    for k in range(at[2] + len(parts[2]) // 2, at[2] + len(parts[2]) // 2 + 20):
        broken[k] ^= 0x5A
    found = got(bytes(broken))
    assert [x[3] for x in found if x[0] == "record"] == ["0", "1", "3", "4", "5"]
    assert [x[1:3] for x in found if x[0] == "gap"] == [(at[2], at[3])]
    # Cut in the middle of a record, and rubbish between records.
    cut = whole[: at[1] + len(parts[1]) // 2] + whole[at[2] : at[3]] + b"rubbish \x1f\x8b\x08 WARC/1. more" + whole[at[3] : at[5] + 10]
    found = got(cut)
    assert [x[3] for x in found if x[0] == "record"] == ["0", "2", "3", "4"]
    spans = [x[1:3] for x in found]
    assert spans[0][0] == 0 and spans[-1][1] == len(cut) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_salvage_of_mixed_and_hopeless_files():
    a, b = page(1, "one"), page(2, "two")
    assert [x[3] for x in got(a + warc.member(b) + a)] == ["1", "2", "1"]
    assert got(b"\0" * 100) == [("gap", 0, 100, "no version line")] and got(b"") == []
    wrong = a.replace(b"one", b"eno")
    assert got(wrong + b) == [("gap", 0, len(a), "block digest differs"), ("record", len(a), len(a) + len(b), "2")]
    inner = warc.member(wrong) + warc.member(b)
    assert [x[0] for x in got(inner)] == ["gap", "record"]
    assert [x[0] for x in got(a.replace(b"Content-Length", b"Content-Width", 2) + b)] == ["gap", "record"]


@pytest.mark.parametrize("seed", range(200))
def test_salvage_never_loses_untouched_records(seed):
    rng = random.Random(seed)
    parts = [(warc.member if rng.random() < 0.5 else bytes)(page(i, "text " * rng.randrange(1, 200))) for i in range(12)]
    hit = set(rng.sample(range(12), 4))
    data = b"".join(rng.choice([p[: rng.randrange(1, len(p))], p[rng.randrange(1, len(p)) :], rng.randbytes(50)]) if i in hit else p for i, p in enumerate(parts))
    found = [x[3] for x in got(data) if x[0] == "record"]
    assert set(found) >= {str(i) for i in range(12) if i not in hit}


def test_reader_logs_gaps(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes(page(1, "one") + b"junk" + page(2, "two"))
    rows = warc.read_archives(spark, str(tmp_path)).orderBy("offset").collect()
    assert [(r.kind, r.page_id) for r in rows] == [("record", 1), ("gap", None), ("record", 2)]
    assert rows[1].length == 4 and rows[1].reason == "no version line" and bytes(rows[2].payload) == b"two"


def test_salvage_inside_a_member():
    rng = random.Random(4)
    pages = [page(i, "".join(chr(rng.randrange(97, 123)) for _ in range(3000))) for i in range(8)]
    bad = pages[3].replace(b"\r\n\r\n", b"\r\n\r\n!", 2)
    one = warc.member(b"".join([*pages[:3], bad, *pages[4:]]))
    after = warc.member(page(9, "after"))
    names = lambda data: [x[3] for x in got(data) if x[0] == "record"]
    assert names(one + after) == ["0", "1", "2", "4", "5", "6", "7", "9"]
    gap = next(x for x in got(one + after) if x[0] == "gap")
    assert gap[1:3] == (0, len(one)) and str(sum(map(len, pages[:3]))) in gap[3]
    whole = warc.member(b"".join(pages))
    cut = whole[: len(whole) * 5 // 8]
    assert names(cut) == ["0", "1", "2", "3"] or names(cut) == ["0", "1", "2", "3", "4"]
    assert [x[0] for x in got(cut)][-1] == "gap"
    crc = bytearray(whole.removesuffix(warc.EMPTY_MEMBER))
    crc[-8] ^= 1
    assert names(bytes(crc) + after) == [*map(str, range(8)), "9"]
    # Long headers have no limit.
    assert names(pages[0].replace(b"X-Page-Id", b"X-Long: " + b"x" * (2 << 20) + b"\r\nX-Page-Id", 1)) == ["0"]
    stored = warc.zlib.compressobj(0, warc.zlib.DEFLATED, 31)
    raw = stored.compress(b"".join(pages)) + stored.flush()
    assert names(raw[:-5]) == [*map(str, range(8))]
