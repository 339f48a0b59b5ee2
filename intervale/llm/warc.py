"""WARC archives: a writer through Spark's own committed files, and a splittable reader of gzip members."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.llm.common import bounded_join, shared_dir, staged

MAGIC = b"\x1f\x8b\x08"
#: Payloads below this many bytes are never written as revisits.
LEAST = 100
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of an archive that one reading task owns.
SPLIT = 16 << 20
#: An empty gzip member; like every member of less than 16 MB it ends with a zero byte, the high byte of its length.
_empty = zlib.compressobj(1, zlib.DEFLATED, 31)
EMPTY = _empty.compress(b"") + _empty.flush()


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    revisit = first is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "" if page_id is None else str(page_id)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]' + chr(39))}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = z.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + z.flush()
    return member if member[-1] == 0 else member + EMPTY


def write_warc(pages: DataFrame, path: str) -> None:
    """Write a record for each row (page_id, url, html) to gzipped WARC files below ``path``, one member a record.

    Of payloads of at least LEAST bytes that are equal, rows with the group's smallest page_id are responses and the
    others revisit it; a group whose ids are all null, and every smaller payload, are responses. Null html is an empty
    payload, a null url is left out, a null page_id gives an empty name. Files are written and committed by Spark's text
    writer, on any file system and safe against retried tasks: a member's last byte is zero, so zero is the separator.
    """
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html"))
    keyed = d.withColumn("digest", F.sha2("html", 256))
    groups = keyed.where(F.octet_length("html") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = staged(groups.where("n > 1").select(F.col("digest").alias("of"), "first"), "warc-groups")
    keyed = bounded_join(keyed, groups, F.col("digest") == F.col("of"), "left")
    first = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([_record(*r)[:-1] for r in rows], pa.binary())], ["value"])

    records = keyed.select("page_id", "url", "html", "digest", first.alias("first")).mapInArrow(run, "value binary")
    records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


class _Range:
    """Bytes of a file from ``start`` on, fetched block by block as they are asked for."""

    def __init__(self, file, size: int, start: int, block: int = 1 << 20):
        self.file, self.size, self.start, self.block, self.data = file, size, start, block, b""

    def until(self, end: int) -> memoryview:
        """The bytes from start to ``end``, or to the file's end."""
        end = min(end, self.size)
        if self.start + len(self.data) < end:
            more = max(self.block, end - self.start - len(self.data))
            self.data += self.file.read_at(min(more, self.size - self.start - len(self.data)), self.start + len(self.data))
        return memoryview(self.data)


def _member(r: _Range, at: int, whole: bool = True) -> tuple[bytes, int] | None:
    """(content, end) of the gzip member at ``at``, both in the file; None if it doesn't decode or isn't a WARC record (an
    empty member is one). With ``whole`` unset only its beginning is decoded, and the end is 0 where it was not met."""
    z, pos, out, step = zlib.decompressobj(31), at, [], 4096
    try:
        while not z.eof:
            data = r.until(pos + step)[pos - r.start : pos - r.start + step]
            if not data:
                return None
            out.append(z.decompress(data))
            pos += len(data)
            if len(out) == 1:
                head = out[0][:7]
                if head and head != b"WARC/1."[: len(head)]:
                    return None
                if not whole and head:
                    return head, 0
            step = 65536
    except zlib.error:
        return None
    return b"".join(out), pos - len(z.unused_data)


def _is_boundary(file, size: int, at: int) -> bool:
    """Whether a member of the file begins at ``at``, told by all before it. Bytes before it that are no member raise."""
    pos = 0
    while pos < at:
        got = _member(_Range(file, size, pos, 1 << 16), pos)
        if got is None:
            raise ValueError(f"bytes at {pos} are not a WARC member: the archive is damaged or cut off")
        pos = got[1]
    return pos == at


def members(file, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the records that start in [start, end).

    Candidates are found by gzip magic and kept if they decode to a WARC header. Within a file's middle the first one
    also needs a member or the file's end right behind it, since its magic may lie inside another record; where there is
    neither, the file is read from its beginning to tell. What follows a member and is neither a member nor the file's end raises;
    a range also tries the member behind its last one, which the next range can't know to begin there.
    """
    r = _Range(file, size, start)
    pos, sure = start, start == 0

    def damaged(at: int) -> bool:
        if _is_boundary(file, size, at):
            raise ValueError(f"bytes at {at} are not a WARC member: the archive is damaged or cut off")
        return False  # these members lie inside a record

    while pos < min(end, size):
        found = bytes(r.until(end + 2)[: end + 2 - start]).find(MAGIC, pos - start) if not sure else pos - start
        if found < 0 or start + found >= end:
            return
        at = start + found
        got = _member(r, at)
        if got is None and sure:
            sure = damaged(at)
            continue
        if got is None or not sure and got[1] < size and (bytes(r.until(got[1] + 3)[got[1] - start : got[1] - start + 3]) != MAGIC or _member(r, got[1], whole=False) is None) and not _is_boundary(file, size, at):
            pos = at + 1
            continue
        if got[0]:
            yield at, got[0]
        pos, sure = got[1], True
    if sure and pos < size and _member(r, pos) is None:
        damaged(pos)


def _fields(raw: bytes) -> dict[str, str]:
    """Header names in lower case; a line that begins with white space goes on with the one before."""
    out, name = {}, ""
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t"):
            out[name] = f"{out.get(name, '')} {line.strip()}"
            continue
        name, _, value = line.partition(":")
        name = name.strip().lower()
        out[name] = value.strip()
    return out


def parse(member: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC headers, HTTP headers, payload) of the records of one member, as a rule one. A block that is no HTTP message is all payload."""
    at = 0
    while at < len(member):
        end = member.find(b"\r\n\r\n", at)
        warc = _fields(member[at:end]) if end >= 0 and member.startswith(b"WARC/1.", at) else {}
        if not warc.get("content-length", "").isascii() or not warc.get("content-length", "").isdigit():
            raise ValueError("bytes of a member are no record")
        block = member[end + 4 : end + 4 + int(warc["content-length"])]
        at = end + 4 + int(warc["content-length"])
        if member[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where its length says")
        at += 4
        if block.startswith(b"HTTP/") or warc.get("content-type", "").lower().startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
            yield warc, _fields(head), payload
        else:
            yield warc, {}, block


def _has_digest(payload: bytes, declared: str) -> bool | None:
    """Whether ``payload`` has the digest, ``algorithm:value`` in hex or base 32; None for algorithms not known here."""
    name, _, value = declared.partition(":")
    name, value = name.strip().lower().replace("-", ""), value.strip()
    if name not in ("md5", "sha1", "sha256", "sha512"):
        return None
    own = hashlib.new(name, payload, usedforsecurity=False)
    return value.lower() == own.hexdigest() or value.upper().rstrip("=") == base64.b32encode(own.digest()).decode().rstrip("=")


READ = "file string, offset bigint, page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary, record_id string, refers_to_id string, sound boolean"


def _row(file: str, at: int, warc: dict[str, str], http: dict[str, str], payload: bytes, payloads: bool) -> tuple:
    def number(name: str | None) -> int | None:
        digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits.isascii() and digits.isdigit() or digits[:1] == "-" and digits[1:].isdigit() else None

    own_id, refers, kind = warc.get("warc-record-id"), warc.get("warc-refers-to"), warc.get("warc-type", "")
    declared = warc.get("warc-payload-digest", "")
    head = file, at, number(own_id), warc.get("warc-target-uri"), kind, number(refers)
    if kind == "revisit":
        name, _, value = declared.partition(":")
        size = http.get("content-length", "")
        hexes = value.lower() if name.lower() == "sha256" and len(value) == 64 else None
        return *head, hexes, int(size) if size.isascii() and size.isdigit() else None, None, own_id, refers, None
    whole = not {"warc-truncated", "warc-segment-number"} & warc.keys() and "transfer-encoding" not in http
    sound = _has_digest(payload, declared) if declared and whole else None
    if sound is False and (own_id or "").startswith("<urn:page:"):
        raise ValueError(f"{file}, record at {at}: the payload doesn't have its digest")
    return *head, hashlib.sha256(payload).hexdigest(), len(payload), payload if payloads else None, own_id, refers, sound


def read_warc(spark: SparkSession, path: str, split: int = SPLIT, payloads: bool = True) -> DataFrame:
    """A row for each record below ``path``: file, offset, page_id, url, record_type, refers_to, payload_digest,
    payload_bytes, payload (null for revisits, or without ``payloads``), record_id, refers_to_id, sound.

    Archives of others are read as well: every type of record is a row, ``record_type`` as it stands there; a block that is no HTTP
    message is the payload; page_id and refers_to are null unless the ids are those ``write_warc`` gives; payload_digest is the
    payload's SHA-256, of revisits the declared one if it is that, and else null; payload_bytes of a revisit is null without a
    length. ``sound`` tells whether the payload has the declared digest (MD5, SHA-1, SHA-256 or SHA-512, in hex or base 32), null where none
    is declared or the payload is cut, segmented or in a transfer coding. Members may hold several records.

    Files are cut into ranges of ``split`` bytes; a task reads its range and what its last record needs beyond, so work
    follows bytes, not files. A record of ``write_warc`` whose payload does not have its digest raises, as does a member that is
    no record. Archives must be on a file system pyarrow opens.
    """
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [(str(x.getPath().toUri()), int(x.getLen())) for x in fs.listStatus(jpath) if x.isFile() and x.getLen() and x.getPath().getName()[0] not in "_."]
    ranges = [(f, n, at, min(at + split, n)) for f, n in files for at in range(0, n, split)]
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pfs

        for b in batches:
            for file, size, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                system, name = pfs.FileSystem.from_uri(file)
                with system.open_input_file(name) as f:
                    rows, held = [], 0
                    for at, record in members(f, size, start, end):
                        rows += (_row(file, at, *x, payloads) for x in parse(record))
                        held += len(record) if payloads else 100
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    at = spark.createDataFrame(ranges, "file string, size bigint, start bigint, end bigint")
    return at.repartition(max(1, len(ranges))).mapInArrow(run, READ)


def op7(spark, sf_dir):
    import uuid

    from intervale.llm.common import table

    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') h, sha256(coalesce(html, '')) d, strlen(coalesce(html, ''))::BIGINT n FROM pages),
g AS (SELECT d, min(page_id) f FROM p WHERE n >= {LEAST} GROUP BY d)
SELECT page_id, n payload_bytes, p.d payload_digest, CASE WHEN f <> page_id THEN 'revisit' ELSE 'response' END record_type,
    CASE WHEN f <> page_id THEN f END refers_to FROM p LEFT JOIN g ON p.d = g.d
"""
