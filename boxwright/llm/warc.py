"""WARC archives: a writer with revisit records, and a reader that salvages what damage leaves.

Archives are written by Spark's text sink and read by its binary source, so they can lie in any store that Spark
reaches. A file is a run of gzip members, one for each record, and a zero byte of padding (the sink's line end).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.llm._spark import cut, shared_dir

LEAST, CHUNK, BROADCAST_BYTES, SALTS = 1000, 8 << 20, 64 << 20, 32
#: The most that a member may inflate to: more doesn't fit a cell, and would be a bomb to the task.
MOST = (1 << 31) - 1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NULL_ID = "<urn:uuid:ffffffff-ffff-8fff-8f0f-ffffffffffff>"


def record_id(page_id: int | None) -> str:
    """A UUID (version 8) that holds the page_id."""
    if page_id is None:
        return _NULL_ID
    h = f"{page_id & 0xFFFFFFFFFFFFFFFF:016x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-8{h[12:15]}-8{h[15]}00-000000000000>"


def page_of(record: str | None) -> int | None:
    m = re.match(r"<urn:uuid:([0-9a-f]{8})-([0-9a-f]{4})-8([0-9a-f]{3})-8([0-9a-f])00-0{12}>\Z", record or "")
    if not m:
        return None
    x = int("".join(m.groups()), 16)
    return x - (1 << 64) if x >= 1 << 63 else x


def record(page_id, url, payload: bytes, size: int, digest: str, refers_to, revisit: bool, date: str = "2024-01-01T00:00:00Z") -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        *([f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, path: str, least: int = LEAST, broadcast_bytes: int = BROADCAST_BYTES) -> None:
    """A record for each row of ``pages`` (page_id, url, html; null html is empty).

    Of the rows with equal payloads of ``least`` bytes or more, that with the largest page_id (each of them, where it
    repeats) is a response and the others revisit it; all smaller ones, and rows of null page_id, are responses. No
    rows give no records. Payloads aren't shuffled: the repeated digests come to them.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload"), "digest": F.sha1("payload")})
    top = cut(rows.filter(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    if 128 * top.count() <= broadcast_bytes:
        rows = rows.join(F.broadcast(top), "digest", "left")
    else:  # the rows of a digest are dealt to several tasks
        top = top.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(top, ["digest", "salt"], "left")
    rows = rows.withColumn("revisit", F.coalesce((F.col("size") >= least) & (F.col("page_id") < F.col("top")), F.lit(False)))

    def archive(batches):
        members, held = [], 0
        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "payload", "size", "digest", "top", "revisit")]
            for i in range(batch.num_rows):
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = record(*(c[i].as_py() for c in cols))
                members.append(z.compress(raw) + z.flush())
                held += len(members[-1])
                if held >= CHUNK:
                    yield pa.record_batch([pa.array([b"".join(members)], pa.binary())], names=["file"])
                    members, held = [], 0
        if members:
            yield pa.record_batch([pa.array([b"".join(members)], pa.binary())], names=["file"])

    files = rows.mapInArrow(archive, "file binary").select(F.col("file").cast("string").alias("value"))
    files.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).option("compression", "none").mode("errorifexists").text(path)


_MARK = re.compile(rb"\x1f\x8b\x08|WARC/[0-9]")
_VERSION = re.compile(rb"WARC/[0-9]\.[0-9]+\r\n")
_ALGORITHMS = ("sha1", "sha256", "sha512", "md5")


def _told(digest: str) -> tuple[str, bytes] | None:
    """Algorithm and bytes of a labelled digest, in hexadecimal or base 32 of either case; None for others."""
    name, _, value = digest.partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip()
    if name not in _ALGORITHMS:
        return None
    size = hashlib.new(name).digest_size
    try:
        if len(value) == 2 * size:
            return name, bytes.fromhex(value)
        value = value.rstrip("=").upper()
        raw = base64.b32decode(value + "=" * (-len(value) % 8))
    except ValueError:
        return None
    return (name, raw) if len(raw) == size else None


def _same(digest: str, part: bytes) -> bool | None:
    """Whether a labelled digest is that of ``part``; None if it can't be told."""
    told = _told(digest)
    return None if told is None else hashlib.new(told[0], part).digest() == told[1]


def _headers(data: bytes, pos: int) -> tuple[dict, int]:
    """Headers of the record at ``pos`` and the place of its block, or ValueError. A line that begins with a blank goes on the one before."""
    m = _VERSION.match(data, pos)
    if not m:
        raise ValueError("no version line")
    head: dict[str, str] = {}
    name, at = None, m.end()
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("no end of headers")
        line = data[at:end]
        at = end + 2
        if not line:
            return head, at
        if line[:1] in b" \t" and name:
            head[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        key, colon, value = line.partition(b":")
        if not colon or not key.strip():
            raise ValueError("bad header")
        name = key.strip().lower().decode("latin-1")
        head[name] = value.strip().decode("utf-8", "replace")


def _payload(head: dict, block: bytes) -> bytes:
    """What follows the headers of an HTTP message, or else the whole block."""
    if head.get("content-type", "").lower().startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _plain(data: bytes, pos: int) -> tuple[dict, bytes, int]:
    """Headers, block and end of the record at ``pos``, or ValueError.

    A block is damaged if its own digest differs. The payload's only counts where the block has none: what a payload
    is, writers don't agree on.
    """
    head, at = _headers(data, pos)
    if not re.fullmatch(r"[0-9]+", head.get("content-length", "")):
        raise ValueError("no length")
    stop = at + int(head["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("length doesn't end the record")
    block = data[at:stop]
    good = _same(head.get("warc-block-digest", ""), block)
    if good is False:
        raise ValueError("warc-block-digest differs")
    if good is None and head.get("warc-type") != "revisit" and _same(head.get("warc-payload-digest", ""), _payload(head, block)) is False:
        raise ValueError("warc-payload-digest differs")
    return head, block, stop + 4


def _member(data: bytes, pos: int) -> tuple[bytes, int]:
    """The content and end of the gzip member at ``pos``, or ValueError."""
    z, out, at, size = zlib.decompressobj(31), [], pos, 0
    try:
        while not z.eof:
            part = z.unconsumed_tail or data[at : at + (1 << 14)]
            if not z.unconsumed_tail:
                if not part:
                    raise ValueError("member is cut")
                at += len(part)
            out.append(z.decompress(part, 1 << 20))
            size += len(out[-1])
            if size > MOST:
                raise ValueError("member inflates to too much")
    except zlib.error as e:
        raise ValueError(f"member: {e}") from None
    return b"".join(out), at - len(z.unused_data)


def _next(data: bytes, pos: int) -> int:
    m = _MARK.search(data, pos)
    return m.start() if m else len(data)


def salvage(data: bytes, base: int = 0) -> Iterator[tuple]:
    """("record", offset, end, headers, block) and ("gap", offset, end, reason, None) over the whole of ``data``.

    After a failed check the next member or version line that holds a valid record ends the gap. Zero bytes and line
    ends between records are padding.
    """
    pos, gap, why = 0, None, ""

    def close(at):
        return [("gap", base + gap, base + at, why, None)] if gap is not None else []

    while pos < len(data):
        if data[pos] in b"\0\r\n" and gap is None:
            pos += 1
            continue
        try:
            if data.startswith(b"\x1f\x8b\x08", pos):
                raw, end = _member(data, pos)
                inner = list(salvage(raw))
                if not any(x[0] == "record" for x in inner):
                    raise ValueError(inner[0][3] if inner else "empty member")
                yield from close(pos)
                gap = None
                # places within a member are the member's
                yield from ((x[0], base + pos, base + end, *x[3:]) for x in inner)
            else:
                head, block, end = _plain(data, pos)
                yield from close(pos)
                gap = None
                yield "record", base + pos, base + end, head, block
            pos = end
        except ValueError as e:
            if gap is None:
                gap, why = pos, str(e)
            pos = _next(data, pos + 1)
    yield from close(len(data))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every record and gap of the archives under ``path``.

    kind is record or gap; file, first and after are its place in bytes, reason says why a gap was quarantined.
    Records have page_id and refers_to (where their ids hold one), url, record_type, payload_bytes and payload_digest
    (lowercase hexadecimal SHA-1) of the full payload, which a revisit takes from its headers, and payload. An
    archive is read by one task, in memory; the writer's have about 8 MB.
    """
    fields = [("kind", pa.string()), ("file", pa.string()), ("first", pa.int64()), ("after", pa.int64()), ("reason", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]

    def parse(batches):
        for batch in batches:
            for file, data in zip(batch.column("path"), batch.column("content")):
                out = []
                for kind, first, after, head, block in salvage(data.as_py()):
                    if kind == "gap":
                        out.append((kind, file.as_py(), first, after, head, None, None, None, None, None, None, None))
                    else:
                        http, again = block.partition(b"\r\n\r\n")[0], head.get("warc-type") == "revisit"
                        payload = _payload(head, block)
                        m = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
                        size = (int(m[1]) if m else None) if again else len(payload)
                        told = _told(head.get("warc-payload-digest", "")) if again else None
                        sha1 = (told[1].hex() if told and told[0] == "sha1" else None) if again else hashlib.sha1(payload).hexdigest()
                        out.append((kind, file.as_py(), first, after, None, page_of(head.get("warc-record-id")), head.get("warc-target-uri"), head.get("warc-type"), size, sha1, page_of(head.get("warc-refers-to")) if again else None, None if again else payload))
                    if len(out) >= 2000:
                        yield pa.record_batch([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])
                        out = []
                if out:
                    yield pa.record_batch([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, "kind string, file string, first long, after long, reason string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def op8_warc(spark, sf_dir: str) -> DataFrame:
    from boxwright.llm._spark import table

    path = f"{shared_dir(spark)}/warc-{uuid.uuid4()}"
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path).filter("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS d FROM pages
), m AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS top FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM m
"""
