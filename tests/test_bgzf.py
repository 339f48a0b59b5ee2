import gzip
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from intervale.sources import bgzf
from intervale.sources import readers as R


def member(text):
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(text) + z.flush()
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H", 6) + b"BC\x02\x00" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(text), len(text))


def blocked(text, most, rng):
    out, at = [], 0
    while at < len(text):
        n = rng.randrange(1, most)
        out.append(member(text[at : at + n]))
        at += n
    return b"".join(out) + member(b"")


class File:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def lines(data, split):
    f = File(data)
    return [x for at in range(0, len(data), split) for some in bgzf.split_lines(f, len(data), at, min(at + split, len(data))) for x in some]


@pytest.mark.parametrize("split", [1, 37, 200, 5000, 1 << 20])
def test_ranges_give_each_line_once(split):
    rng = random.Random(split)
    texts = [b"", b"\n", b"\n\n\n", b"no end", b"a\r\n\r\nb\n", b"x" * 9000 + b"\ny", b"\xef\xbb\xbfa\tb\n"]
    texts += [b"".join(bytes(rng.choice(b"ab\xc3\t ") for _ in range(rng.randrange(40))) + b"\n" for _ in range(200)) for _ in range(2)]
    for text in texts:
        data = blocked(text, 90 if split > 1 or len(text) < 9 else 900, rng)
        assert gzip.decompress(data) == text
        assert lines(data, split if len(data) < 100 * split else max(split, len(data) // 100)) == text.removeprefix(b"\xef\xbb\xbf").splitlines()


def test_damage_raises():
    data = blocked(b"a line of text\n" * 100, 200, random.Random(1))
    hurt = data[: len(data) // 2] + bytes(20) + data[len(data) // 2 + 20 :]
    for bad in (hurt, data[:-40], data + b"padding"):
        with pytest.raises(ValueError, match="damaged"):
            lines(bad, 1 << 20)


def test_large_files_are_read_in_ranges(spark, tmp_path):
    rng = random.Random(3)
    text = "#head\n" + "".join(f"chr{rng.randrange(1, 9)}\t{i}\t{i + rng.randrange(50)}\tn{i}\n" for i in range(4000))
    for name, data in (("a b%20é.bed.gz", blocked(text.encode(), 5000, rng)), ("x + y%plain.bed.gz", gzip.compress(text.encode())), ("small.bed.gz", blocked(b"1\t2\t3\n", 9, rng))):
        (tmp_path / name).write_bytes(data)
    want = [(i, x) for i, x in enumerate(text.splitlines())][1:]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = {}
    for size in ("2000", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            ranged = bgzf.blocked(spark, R.list_files(spark, f"{tmp_path}/*.gz"), 2000)
            assert [p.rsplit("/", 1)[1] for p, _ in ranged] == ["a b%20é.bed.gz"]
            c = R.read_intervals(spark, f"{tmp_path}/*.gz")
            rows = [tuple(r) for r in c.intervals.select("file_name", "row_ord", "line", "chrom", "start", "end").collect()]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        got[size] = sorted(rows)
        assert sorted(r[1:3] for r in rows if r[0].endswith("plain.bed.gz")) == want
        assert c.names.join(c.intervals, "file_name", "left_semi").count() == 3
    assert len(got[before]) == 2 * len(want) + 1 and got["2000"] == got[before]


def test_named_files_are_packed_by_many_tasks(spark, tmp_path):
    """A file is blocked gzip in its lines' order, whole, from as many tasks as it is long; ids don't hang on them."""
    rows = spark.range(60_000).select(F.when(F.col("id") % 9 == 0, "b").otherwise("a").alias("file_name"), F.concat_ws("\t", F.lit("chr1"), "id", F.col("id") + 5, F.md5(F.col("id").cast("string"))).alias("line"), (-F.col("id")).alias("back"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        R.write_named(rows, str(tmp_path / "o"), ".bed.gz", order=["back"])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    for name in "ab":
        data = (tmp_path / "o" / f"{name}.bed.gz").read_bytes()
        ids = [int(x.split(b"\t")[1]) for x in gzip.decompress(data).splitlines()]
        assert ids == [i for i in range(59_999, -1, -1) if (i % 9 == 0) == (name == "b")]
        assert bgzf.member_size(data[:99]) is not None
        last = sum(0 < len(text) < bgzf.TEXT for _, text in bgzf.members(File(data), len(data), 0))  # of each task
        assert last > (name == "a")
    c = R.read_intervals(spark, f"{tmp_path}/o/*.gz").intervals
    assert c.count() == 60_000
    assert c.where("file_name LIKE '%/a.bed.gz' AND start = 59999").first().row_ord == 0
