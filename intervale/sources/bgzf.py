"""Splittable reading of blocked gzip (BGZF) text: a file of gzip members of at most 64 KiB that each name their length."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: the beginning of a member with extra fields, the extra field that holds a member's length less one.
MAGIC, FIELD = b"\x1f\x8b\x08\x04", b"BC\x02\x00"
#: Bytes fetched at a time; a member has at most 65,536.
FETCH = 1 << 20
#: Bytes of lines sent to the JVM at a time.
BATCH = 1 << 20
LINES = "file_name string, block bigint, value binary, place bigint"


def member_size(head: bytes) -> int | None:
    """Length of the member that begins with ``head``, from its extra fields; None if it names none."""
    if len(head) < 12 or head[:4] != MAGIC:
        return None
    extra, at = head[12 : 12 + struct.unpack_from("<H", head, 10)[0]], 0
    while at + 4 <= len(extra):
        if extra[at : at + 4] == FIELD and at + 6 <= len(extra):
            return struct.unpack_from("<H", extra, at + 4)[0] + 1
        at += 4 + struct.unpack_from("<H", extra, at + 2)[0]
    return None


def _open(path: str, write: bool = False):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(quote(path, safe="/:"))
    return system.open_output_stream(name) if write else system.open_input_file(name)


#: Bytes of text in a member that is written: whatever they are, the member stays below 64 KiB, and its last byte is zero.
TEXT = 65280


def member(text: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(text) + z.flush()
    return MAGIC + bytes(5) + b"\xff" + struct.pack("<H", 6) + FIELD + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(text), len(text))


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (name, value), of which those of a name follow one another, as members (name, number, value) of the names' lines. A member is
    without its last byte, a zero."""
    number, name, held = 0, None, b""
    for b in batches:
        names, numbers, out = [], [], []

        def put(text: bytes) -> None:
            nonlocal number
            names.append(name)
            numbers.append(number)
            out.append(member(text)[:-1])
            number += 1

        keys, values = b.column(0).to_pylist(), b.column(1).to_pylist()
        at = 0
        while at < len(keys):
            if keys[at] != name:
                if held:
                    put(held)
                name, held = keys[at], b""
            end = len(keys) if keys[-1] == name else next(i for i in range(at, len(keys)) if keys[i] != name)
            held += ("\n".join(values[at:end]) + "\n").encode()
            cut = 0
            while len(held) - cut >= TEXT:
                put(held[cut : cut + TEXT])
                cut += TEXT
            held, at = held[cut:], end
        yield _members(names, numbers, out)
    if held:
        yield _members([name], [number], [member(held)[:-1]])


def _members(names: list[str], numbers: list[int], out: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int64()), pa.array(out, pa.binary())], ["name", "number", "value"])


def join_parts(spark: SparkSession, files: list[tuple[str, list[str]]], folder: str) -> dict[str, str]:
    """Where, below ``folder``, the parts of each of ``files`` (name, paths in order) lie as one file: a task a file, which copies bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, paths in zip(*(c.to_pylist() for c in b.columns), strict=True):
                target = f"{folder}/joined-{uuid.uuid4().hex}"  # a task that is run again has another
                with _open(target, write=True) as out:
                    for path in paths:
                        with _open(path) as f:
                            while data := f.read(FETCH):
                                out.write(data)
                    out.write(member(b""))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([target])], ["name", "target"])

    rows = spark.createDataFrame(spark.sparkContext.parallelize(files, max(1, len(files))), "name string, paths array<string>")
    return {r.name: r.target for r in rows.mapInArrow(run, "name string, target string").collect()}


def range_bytes(spark: SparkSession, files: list[tuple[str, int]]) -> int:
    """Bytes of a range: as Spark deals plain files over its cores, but a quarter of the largest split, since the text is about four
    times as long."""
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() // 4
    return max(1, min(most, max(1 << 20, sum(n for _, n in files) // (2 * spark.sparkContext.defaultParallelism))))


def _content(data: bytes, at: int) -> tuple[bytes, int] | None:
    """(text, length) of the member at ``at``; None where none begins or its checksum is wrong."""
    size = member_size(data[at : at + 12 + 65535])
    if size is None or at + size > len(data):
        return None
    z = zlib.decompressobj(31)
    try:
        text = z.decompress(data[at : at + size])
    except zlib.error:
        return None
    return (text, size) if z.eof and not z.unused_data else None


def members(file, size: int, start: int) -> Iterator[tuple[int, bytes]]:
    """(offset, text) of the members from the first that begins at or after ``start`` to the file's end. Bytes behind a member that are
    none raise."""
    data, at, pos, sure = b"", start, start, start == 0  # data begins at ``at``
    while pos < size:
        if at + len(data) - pos < 2 * 65536 and at + len(data) < size:
            data, at = data[pos - at :], pos
            data += file.read_at(min(FETCH, size - at - len(data)), at + len(data))
        if not sure:
            found = data.find(MAGIC, pos - at)
            if found < 0:
                pos = max(pos + 1, at + len(data) - 3)
                if at + len(data) >= size:
                    return
                continue
            if found > pos - at:
                pos = at + found
                continue
        got = _content(data, pos - at)
        if got is None:
            if sure:
                raise ValueError(f"bytes at {pos} are not a member of blocked gzip: the file is damaged or cut off")
            pos += 1
            continue
        yield pos, got[0]
        pos, sure = pos + got[1], True


def split_lines(file, size: int, start: int, end: int) -> Iterator[list[bytes]]:
    """Lines of the range [start, end) of a file's bytes: those behind the first line end in members that begin in the range (from
    the first line on, at 0), to the first line end in members beyond it. So each line is in one range."""
    rest = None if start else []  # none: in the line that began before the range
    for offset, text in members(file, size, start):
        beyond = offset >= end
        if rest is None:
            if beyond:
                return
            _, found, text = text.partition(b"\n")
            if not found:
                continue
            rest = []
        if offset == 0:
            text = text.removeprefix(b"\xef\xbb\xbf")
        cut = (text.find(b"\n") if beyond else text.rfind(b"\n")) + 1
        if cut:
            yield b"".join([*rest, text[:cut]]).splitlines()
            if beyond:
                return
            rest = [text[cut:]]
        else:
            rest.append(text)
    if last := b"".join(rest or []):
        yield last.splitlines()


def blocked(spark: SparkSession, files: list[tuple[str, int]], more_than: int) -> list[tuple[str, int]]:
    """Those of ``files`` (path, bytes) above ``more_than`` bytes that are blocked gzip, told by their first member. Files on a file
    system that Arrow can't open are not among them."""
    large = [(p, n) for p, n in files if p.endswith(".gz") and n > more_than]
    if not large:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for path in b.column(0).to_pylist():
                try:
                    with _open(path) as f:
                        good.append(member_size(f.read_at(12 + 65535, 0)) is not None)
                except (OSError, NotImplementedError, pa.ArrowException):
                    good.append(False)
            yield b.filter(pa.array(good, pa.bool_()))

    d = spark.createDataFrame(large, "path string, bytes bigint")
    found = {r.path for r in d.repartition(min(len(large), 200)).mapInArrow(run, d.schema).collect()}
    return [x for x in large if x[0] in found]


def read_lines(spark: SparkSession, files: list[tuple[str, int]], split: int) -> DataFrame:
    """(file_name, block, line, place) of blocked gzip files, read in ranges of ``split`` bytes, a task each: the range's first byte
    and the line's number in it from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                place, held, bytes_held = 0, [], 0
                with _open(path) as f:
                    for some in split_lines(f, size, start, min(start + split, size)):
                        held += some
                        bytes_held += sum(map(len, some)) + 8 * len(some)
                        if bytes_held >= BATCH:
                            yield _batch(path, start, held, place)
                            place, held, bytes_held = place + len(held), [], 0
                    if held:
                        yield _batch(path, start, held, place)

    rows = _ranges(spark, files, split).mapInArrow(run, LINES)
    return rows.select("file_name", "block", F.col("value").cast("string").alias("line"), "place")


def _ranges(spark: SparkSession, files: list[tuple[str, int]], split: int) -> DataFrame:
    """A row and a task for each range."""
    ranges = [(p, n, at) for p, n in files for at in range(0, n, split)]
    return spark.createDataFrame(spark.sparkContext.parallelize(ranges, len(ranges)), "path string, size bigint, start bigint")


def count_lines(spark: SparkSession, files: list[tuple[str, int]], split: int) -> DataFrame:
    """(file_name, block, n): how many lines ``read_lines`` has of each range that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with _open(path) as f:
                    n = sum(map(len, split_lines(f, size, start, min(start + split, size))))
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([start], pa.int64()), pa.array([n], pa.int64())], ["file_name", "block", "n"])

    return _ranges(spark, files, split).mapInArrow(run, "file_name string, block bigint, n bigint")


def _batch(path: str, start: int, lines: list[bytes], place: int) -> pa.RecordBatch:
    n = len(lines)
    return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array([start] * n, pa.int64()), pa.array(lines, pa.binary()), pa.array(range(place, place + n), pa.int64())], ["file_name", "block", "value", "place"])
