"""Media columns: signature sniffing with an Aho-Corasick automaton, format validators, correction of declared types and
carving of embedded media; and a lossless store of text bytes as samples or pixels."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A payload is padded to a multiple of this: 64 pixels of three bytes.
UNIT, WIDTH, PAD = 192, 64, b" "
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


@dataclass(frozen=True)
class Found:
    """A validated medium: type, start, length, and where its raw samples lie as (start, length) in the container; for
    PNG the samples are compressed and ``raw`` is None."""

    mime: str
    start: int
    length: int
    raw: tuple[int, int] | None = None


def _wav(b: bytes, at: int) -> Found | None:
    if b[at + 8 : at + 12] != b"WAVE":
        return None
    (n,) = struct.unpack_from("<I", b, at + 4)
    end, pos, raw, known = at + 8 + n, at + 12, None, False
    if end > len(b):
        return None
    while pos + 8 <= end:
        name, (size,) = b[pos : pos + 4], struct.unpack_from("<I", b, pos + 4)
        if pos + 8 + size > end:
            return None
        known |= name == b"fmt " and size >= 16
        if name == b"data" and raw is None:
            raw = (pos + 8, size)
        pos += 8 + size + (size & 1)
    return Found("audio/wav", at, n + 8, raw) if known and raw else None


def _bmp(b: bytes, at: int) -> Found | None:
    if at + 54 > len(b):
        return None
    size, zero, offset, header, width, height, planes, bits, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    if zero or header < 40 or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or packed or width <= 0 or offset < 14 + header:
        return None
    raw = (width * bits + 31) // 32 * 4 * abs(height)
    return Found("image/bmp", at, size, (at + offset, raw)) if raw and offset + raw == size and at + size <= len(b) else None


def _ppm(b: bytes, at: int) -> Found | None:
    head = b[at : at + 40].split(b"\n", 3)
    if len(head) < 4 or head[2] != b"255":
        return None
    wide, _, high = head[1].partition(b" ")
    if not (wide.isdigit() and high.isdigit()):
        return None
    start = at + sum(len(x) + 1 for x in head[:3])
    raw = int(wide) * int(high) * 3
    return Found("image/x-portable-pixmap", at, start - at + raw, (start, raw)) if raw and start + raw <= len(b) else None


def _au(b: bytes, at: int) -> Found | None:
    if at + 24 > len(b):
        return None
    offset, size, encoding, rate, channels = struct.unpack_from(">IIIII", b, at + 4)
    good = offset >= 24 and 1 <= encoding <= 27 and rate and 0 < channels < 256 and at + offset + size <= len(b)
    return Found("audio/basic", at, offset + size, (at + offset, size)) if good else None


def _png(b: bytes, at: int) -> Found | None:
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        (size,), name = struct.unpack_from(">I", b, pos), b[pos + 4 : pos + 8]
        if pos + 12 + size > len(b) or first and (name != b"IHDR" or size != 13):
            return None
        if struct.unpack_from(">I", b, pos + 8 + size)[0] != zlib.crc32(memoryview(b)[pos + 4 : pos + 8 + size]):
            return None
        pos, first = pos + 12 + size, False
        if name == b"IEND":
            return Found("image/png", at, pos - at)
    return None


def _gif(b: bytes, at: int) -> Found | None:
    if at + 13 > len(b):
        return None
    pos = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0)
    while pos < len(b):
        kind = b[pos]
        if kind == 0x3B:
            return Found("image/gif", at, pos + 1 - at)
        if kind == 0x2C and pos + 11 <= len(b):
            pos += 11 + (3 << (b[pos + 9] & 7) + 1 if b[pos + 9] & 128 else 0)
        elif kind == 0x21:
            pos += 2
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += b[pos] + 1
        pos += 1
    return None


def _jpeg(b: bytes, at: int) -> Found | None:
    pos = at + 2
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        kind, (size,) = b[pos + 1], struct.unpack_from(">H", b, pos + 2)
        if not 0xC0 <= kind <= 0xFE or size < 2:
            return None
        pos += 2 + size
        if kind == 0xDA:
            end = b.find(b"\xff\xd9", pos)
            return Found("image/jpeg", at, end + 2 - at) if end >= 0 else None
    return None


#: The formats' magic bytes.
MAGIC: dict[bytes, Callable[[bytes, int], Found | None]] = {
    b"RIFF": _wav, b"BM": _bmp, b"P6\n": _ppm, b".snd": _au, PNG_MAGIC: _png, b"GIF87a": _gif, b"GIF89a": _gif, b"\xff\xd8\xff": _jpeg,
}


@cache
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for magic in MAGIC:
        out.add_word(magic.decode("latin-1"), magic)
    out.make_automaton()
    return out


def scan(data: bytes) -> list[Found]:
    """Validated media in ``data`` by start: the container at 0, if any, and what lies embedded in it or elsewhere; of
    embedded ones that overlap, the first."""
    out: list[Found] = []
    free = 0
    for last, magic in _automaton().iter(data.decode("latin-1")):
        at = last + 1 - len(magic)
        if at < free:
            continue
        if (found := MAGIC[magic](data, at)) is not None:
            out.append(found)
            free = 1 if at == 0 else at + found.length
    return out


def sniff(data: bytes, declared: str | None) -> tuple[str, bool, list[Found]]:
    """(the type, whether it differs from the declared one, the embedded media); without a container at the start that
    validates, the declared type, or ``application/octet-stream`` where it names a type that was refuted."""
    found = scan(data)
    own = found[0].mime if found and found[0].start == 0 else None
    known = {"audio/wav", "image/bmp", "image/x-portable-pixmap", "audio/basic", "image/png", "image/gif", "image/jpeg"}
    mime = own or ("application/octet-stream" if declared is None or declared in known else declared)
    return mime, mime != declared, [x for x in found if x.start]


def store(payload: bytes, kind: int) -> bytes:
    """``payload``, a positive multiple of UNIT bytes, as a WAV, BMP, PPM, AU or PNG file, by ``kind`` modulo five."""
    n = len(payload)
    high = n // UNIT
    kind %= 5
    if kind == 0:
        return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", n + 36, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", n) + payload
    if kind == 1:
        return struct.pack("<2sIIIIiiHHIIiiII", b"BM", n + 54, 0, 54, 40, WIDTH, -high, 1, 24, 0, n, 2835, 2835, 0, 0) + payload
    if kind == 2:
        return b"P6\n%d %d\n255\n" % (WIDTH, high) + payload
    if kind == 3:
        return struct.pack(">4sIIIII", b".snd", 24, n, 2, 8000, 1) + payload
    rows = np.zeros((high, UNIT + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(high, UNIT)
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(name)))
    return PNG_MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, high, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def read_back(data: bytes, found: Found) -> bytes:
    """The stored samples or pixels of a container that ``store`` wrote."""
    if found.raw is not None:
        return data[found.raw[0] : found.raw[0] + found.raw[1]]
    parts, pos = [], found.start + 8
    while pos < found.start + found.length:
        (size,) = struct.unpack_from(">I", data, pos)
        if data[pos + 4 : pos + 8] == b"IDAT":
            parts.append(data[pos + 8 : pos + 8 + size])
        pos += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(-1, UNIT + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def padded(raw: bytes) -> bytes:
    """``raw`` with bytes 32 appended up to a positive multiple of UNIT."""
    return raw + PAD * (-len(raw) % UNIT if raw else UNIT)


def features(payload: bytes) -> str:
    """Sample statistics as integers: sum, least, largest, number of neighbours that differ."""
    x = np.frombuffer(payload, np.uint8)
    return f"{int(x.sum(dtype=np.int64))}:{x.min()}:{x.max()}:{int(np.count_nonzero(x[1:] != x[:-1]))}"


def correct_types(df: DataFrame, content: str = "content", declared: str = "declared") -> DataFrame:
    """``df``'s content and declared columns with ``mime``, ``corrected`` and ``embedded``: array of (mime, start, length).

    Null contents are empty and have no media; null declared types count as unknown; other columns are not read.
    """
    kind = "content binary, declared string, mime string, corrected boolean, embedded array<struct<mime:string,start:bigint,length:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [sniff(x or b"", d) for x, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            inner = [[{"mime": f.mime, "start": f.start, "length": f.length} for f in r[2]] for r in rows]
            item = pa.list_(pa.struct([("mime", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array(inner, item)], ["content", "declared", "mime", "corrected", "embedded"])

    return df.select(F.col(content).cast("binary").alias("content"), F.col(declared).cast("string").alias("declared")).mapInArrow(run, kind)


def carve(df: DataFrame, content: str = "content") -> DataFrame:
    """One row for each embedded medium: mime, start, length and its bytes."""
    typed = correct_types(df.select(F.col(content).alias("content"), F.lit(None).cast("string").alias("declared")))
    return typed.select("content", F.explode("embedded").alias("x")).select("x.*", F.expr("substring(content, int(x.start) + 1, int(x.length))").alias("bytes"))


OP10 = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
TYPES = ("audio/wav", "image/bmp", "image/x-portable-pixmap", "audio/basic", "image/png")


def store_texts(docs: DataFrame) -> DataFrame:
    """One row for each document: its text's bytes stored as a medium under a type declared from another byte of the
    checksum, so mostly wrong; the type is corrected by sniffing, the payload read back and described.

    Narrow, row by row: null and empty texts become one padded unit, ids may be null or repeat, other columns aren't
    read, an empty table gives none.
    """

    def one(raw: bytes) -> tuple:
        payload = padded(raw)
        mark = zlib.crc32(payload)
        media = store(payload, mark)
        declared = TYPES[(mark >> 8) % 5]
        found = scan(media)
        if not found or found[0].start:
            raise ValueError("a stored medium doesn't validate")
        back = read_back(media, found[0])
        feature = f"{found[0].mime}:{int(found[0].mime != declared)}:{len(found) - 1}:{features(back)}"
        return len(raw), len(back), sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), sha256(media).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            cols = list(zip(*(one(x.as_py() or b"") for x in b.column(1)), strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [x.split()[0] for x in OP10.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw")).mapInArrow(run, OP10)


def op10(spark, sf_dir):
    from intervale.llm.common import table

    return store_texts(table(spark, sf_dir, "documents"))
