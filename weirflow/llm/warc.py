"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

Writing.  Each row becomes one record in a gzip member of its own.  Members go out through Spark's text
writer (any Hadoop store, with its commit protocol): the line separator is a zero byte, and every member
ends with the zero byte that the separator supplies (the last byte of its length; records of 16 MiB and
more are followed by an empty member, which ends so as well).  Of equal payloads of at least
``MIN_REVISIT`` bytes the row with the largest id is the response, the others are revisits without a
body.  Digests and their groups are found natively; only digests that occur twice are joined back.

Reading.  A file is a run of gzip members, plain records, or both.  A record must have a version line, a
header end, its whole block, the closing blank line, and digests that match.  After a failed check the
reader logs the bytes as a gap and goes on at the next place that passes the same checks: the declared end
of the record if it does, else the next gzip magic or version line.  Inside a member the same holds for
its inflated bytes; a gap there has the member's offset and names the inner offsets.  Of a member that is
cut off or does not inflate with its checksum, what inflated before is read as well; after an error of
zlib, its records count only if a block digest proves them.  Each file is one row of ``binaryFile`` (below 2 GiB); the writer's files are one task
each, so they follow the partition size.

Defined cases: null payloads are empty; null ids write no id header and read back as null; null or
multi-line addresses are escaped; rows that share the largest id are all responses; empty tables give
empty archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.durable import materialize, new_path, small_join

MIN_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_MEMBER = b"\x1f\x8b\x08" + bytes(6) + b"\xff\x03\x00" + bytes(8)
END, CRLF, MAGIC = b"\r\n\r\n", b"\r\n", b"\x1f\x8b\x08"
READ = (
    "path string, offset long, length long, kind string, reason string, record_type string, page_id long, target_uri string, "
    "payload_bytes long, payload_digest string, refers_to long, payload binary"
)


def _uuid(*parts) -> str:
    h = hashlib.sha1("|".join(map(str, parts)).encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}>"


def _b32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(page_id: int | None, uri: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record; ``refers_to`` makes it a revisit, whose payload is left out."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    if not revisit:
        block += payload or b""
    uri = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in uri or "urn:none")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_uuid(page_id, digest, revisit)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: {_b32(digest)}", f"WARC-Block-Digest: {_b32(hashlib.sha1(block).hexdigest())}", "Content-Type: application/http;msgtype=response",
        f"X-Payload-Length: {size}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_uuid(refers_to, digest, False)}", f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + END + block + END


def member(data: bytes) -> bytes:
    """A gzip member that ends with a zero byte."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if out[-1] == 0 else out + EMPTY_MEMBER


def _write(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        out, held = [], 0
        for row in batch.to_pylist():
            body = None if row["payload"] is None else row["payload"].encode("utf-8", "surrogatepass")
            out.append(member(record(row["page_id"], row["url"], body, row["size"], row["digest"], row["refers_to"]))[:-1])
            held += len(out[-1])
            if held > 16 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write_pages(pages: DataFrame, path: str) -> None:
    """Archive ``pages(page_id, url, html)`` below ``path``."""
    body = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").alias("payload"), F.octet_length(body).cast("long").alias("size"), F.sha1(body.cast("binary")).alias("digest"))
    twice = rows.filter(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1 and last is not null")
    rows = small_join(rows, materialize(twice.select("digest", "last"), "repeated"), ["digest"])
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    rows = rows.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "size", "digest", F.when(revisit, F.col("last")).alias("refers_to"))
    rows.mapInArrow(_write, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)


class Bad(Exception):
    """A failed check; ``end`` is where the damaged piece says it ends."""

    def __init__(self, reason: str, end: int | None = None):
        super().__init__(reason)
        self.end = end


def _digest_ok(stated: str, data: bytes) -> bool:
    kind, _, value = stated.partition(":")
    if kind.lower() != "sha1" or not value:
        return True
    h = hashlib.sha1(data)
    return value.lower() == h.hexdigest() or value.upper() == base64.b32encode(h.digest()).decode()


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record whose version line starts at ``at``, and where the next one may start."""
    if data[at : at + 7] != b"WARC/1." and data[at : at + 7] != b"WARC/0.":
        raise Bad("no version line")
    fields, here = {}, data.find(CRLF, at) + 2
    while True:
        stop = data.find(CRLF, here)
        if here < 2 or stop < 0:
            raise Bad("no end of header")
        if stop == here:
            break
        line, here = data[here:stop], stop + 2
        name, colon, value = line.partition(b":")
        if not colon or min(line) < 32 and min(line.replace(b"\t", b" ")) < 32:
            raise Bad("header line without a colon or with control characters")
        name = name.strip().lower().decode("latin-1")
        if name in fields and name != "warc-concurrent-to":  # a cut header that runs into the next one
            raise Bad("header field twice")
        fields[name] = value.strip().decode("utf-8", "replace")
    try:
        size = int(fields["content-length"])
    except (KeyError, ValueError):
        raise Bad("no content length") from None
    first, end = stop + 2, stop + 2 + size
    if size < 0 or end + 4 > len(data):
        raise Bad("block is cut off")
    if data[end : end + 4] != END:
        raise Bad("no blank line after the block", end + 4)
    block = data[first:end]
    if not _digest_ok(fields.get("warc-block-digest", ""), block):
        raise Bad("block digest differs", end + 4)
    kind = fields.get("warc-type", "")
    http = fields.get("content-type", "").startswith("application/http")
    payload = block[block.find(END) + 4 :] if http and END in block else block
    if kind != "revisit" and not _digest_ok(fields.get("warc-payload-digest", ""), payload):
        raise Bad("payload digest differs", end + 4)
    return {"fields": fields, "type": kind, "payload": payload, "proved": fields.get("warc-block-digest", "").lower().startswith("sha1:")}, end + 4


def inflate(data: bytes, at: int) -> tuple[bytes, list[tuple[int, int]], str | None]:
    """What inflates of the gzip member at ``at``, (bytes used up to, bytes inflated) by step, and what is wrong."""
    failed, reason = len(data), None
    for _ in range(2):
        z, out, marks, used, size = zlib.decompressobj(31), [], [], at, 0
        try:
            while not z.eof and used < len(data):
                # The second time, the piece with the error or the cut is taken byte by byte, for all that inflates before it.
                last, step = used, 1 if used >= failed else 1 << 20
                piece = z.decompress(data[used : used + step])
                used = min(used + step, len(data))
                size += len(piece)
                out.append(piece)
                marks.append((used - len(z.unused_data), size))
        except zlib.error as e:
            failed, reason = used, f"gzip: {e}"
        else:
            if z.eof:
                return b"".join(out), marks, None
            failed, reason = last, "gzip member is cut off"
    return b"".join(out), marks, reason


def _record(data: bytes, at: int, proved: bool) -> tuple[dict, int]:
    got, end = parse_record(data, at)
    if proved and not got["proved"]:
        raise Bad("no digest in a damaged member", end)
    return got, end


def parse_member(data: bytes, at: int) -> tuple[list[tuple[str, int, int, object]], int, str | None]:
    """Records and inner gaps of the member at ``at``, where reading may go on, and what is wrong with the member.

    Of a damaged member, that is behind its last good record, or ``at`` if there is none.
    """
    body, marks, wrong = inflate(data, at)
    found, here, proved = [], 0, wrong is not None and wrong.startswith("gzip:")
    while here < len(body):
        if body[here] in CRLF:
            here += 1
            continue
        try:
            got, end = _record(body, here, proved)
            found.append(("record", here, end, got))
        except Bad as e:
            end = _resume(body, here, e.end, (b"WARC/",), lambda x: bool(_record(body, x, proved)))
            found.append(("gap", here, end, f"in member, {here} to {end}: {e}"))
        here = end
    if wrong is None:
        return found, marks[-1][0], None
    while found and found[-1][0] == "gap":
        found.pop()
    return found, next(used for used, size in marks if size >= found[-1][2]) if found else at, wrong


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """('record', start, end, record) and ('gap', start, end, reason), in order, covering all but padding."""

    def valid(x: int) -> bool:
        if data[x : x + 3] != MAGIC:
            return bool(parse_record(data, x))
        found, _, wrong = parse_member(data, x)
        return any(kind == "record" for kind, *_ in found) or not found and wrong is None

    at = 0
    while at < len(data):
        if data[at] in CRLF:
            at += 1
            continue
        stated, wrong = None, None
        if data[at : at + 3] == MAGIC:
            found, end, wrong = parse_member(data, at)
            for kind, _, _, got in found:
                yield kind, at, end, got
            at = end
        else:
            try:
                got, end = parse_record(data, at)
                yield "record", at, end, got
                at = end
            except Bad as e:
                stated, wrong = e.end, str(e)
        if wrong is not None:
            end = _resume(data, at, stated, (MAGIC, b"WARC/"), valid)
            yield "gap", at, end, wrong
            at = end


def _resume(data: bytes, at: int, stated: int | None, marks: tuple[bytes, ...], check) -> int:
    """The next place after ``at`` that passes all checks."""

    def valid(x: int) -> bool:
        try:
            return check(x)
        except Bad:
            return False

    if stated is not None and (stated >= len(data) or valid(stated)):
        return min(stated, len(data))
    search, ahead = at + 1, [-2] * len(marks)
    while True:
        for k, mark in enumerate(marks):
            if ahead[k] != -1 and ahead[k] < search:
                ahead[k] = data.find(mark, search)
        places = [x for x in ahead if x >= 0]
        if not places:
            return len(data)
        if valid(x := min(places)):
            return x
        search = x + 1


def reader(with_payload: bool):
    """A mapInArrow function over (path, content)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [x.split()[0] for x in READ.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        types = [kinds[x.split()[1]] for x in READ.split(", ")]
        whole = lambda x: int(x) if x is not None and x.lstrip("-").isdigit() else None

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for kind, start, end, got in salvage(content.as_py()):
                    if kind == "gap":
                        rows.append((path, start, end - start, kind, got, None, None, None, None, None, None, None))
                    else:
                        f, body = got["fields"], got["payload"]
                        if got["type"] == "revisit":
                            size, stated = whole(f.get("x-payload-length")), f.get("warc-payload-digest", "").partition(":")[2]
                            digest = base64.b32decode(stated).hex() if len(stated) == 32 else stated.lower()
                        else:
                            size, digest = len(body), hashlib.sha1(body).hexdigest()
                        rows.append((path, start, end - start, kind, None, got["type"], whole(f.get("x-page-id")), f.get("warc-target-uri"), size, digest, whole(f.get("x-refers-to-page")), body if with_payload else None))
                        held += len(body) * with_payload
                    if len(rows) >= 10_000 or held > 16 << 20:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records and quarantined gaps of all archives below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(reader(with_payload), READ)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archives")
    write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path, False).filter("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op1_warc": op1_warc}
SQL = {
    "op1_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to FROM q"""
}
