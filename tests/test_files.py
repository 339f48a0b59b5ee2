import gzip
import io
import json
import threading
import urllib.request

import pytest
from pyspark.sql import functions as F

from intervale import cli, server
from intervale.functions.scalars import field
from intervale.plans.index import IntervalIndex, build_index
from intervale.plans.search import Search
from intervale.sources import metadata as M
from intervale.sources import readers as R
from intervale.streaming.queries import stream_counts

CONF = "3 interval_length int_32\n5 is_important int_8\n6 feature string 10\n4 score double\n7 strand char\n"
META = ["100 200 100 1.25 1 abc +", "200 230 30 5 0 defg *", "250 300 50 0.03125 0 hijklmnop +", "300 500 200 456.5 1 qrstuvwxyzabcdef -"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    with gzip.open(d / "a.bed.gz", "wt") as f:
        f.write("#comment\ntrack x\nchr1\t10\t20\tp\nchr1\t15\t30\tq\nchr2\t5\n1\t9\t3\n")
    with gzip.open(d / "b.bed.gz", "wt") as f:
        f.write("1\t100\t200\tr\n")
    with gzip.open(d / "empty.bed.gz", "wt"):
        pass
    with gzip.open(d / "c.vcf.gz", "wt") as f:
        f.write("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n1\t12\t.\tACG\tA\t.\t.\t.\n1\t40\t.\tA\t<DEL>\t.\t.\tSVTYPE=DEL;SVLEN=-50\nchr1\t300\t.\tA\tT\t.\t.\tEND=350;X=1\n")
    return d


def test_readers(spark, folder):
    c = R.read_intervals(spark, f"{folder}/*.gz")
    got = sorted((r.file_name.rsplit("/", 1)[1], r.chrom, r.start, r.end) for r in c.intervals.collect())
    assert got == [("a.bed.gz", "1", 10, 20), ("a.bed.gz", "1", 15, 30), ("b.bed.gz", "1", 100, 200), ("c.vcf.gz", "1", 12, 15), ("c.vcf.gz", "1", 40, 90), ("c.vcf.gz", "1", 300, 351)]
    assert sorted(r.reason for r in c.rejects.collect()) == ["columns", "inverted"]
    assert c.names.count() == 4
    with pytest.raises(ValueError):
        R.file_format("x.txt")
    with pytest.raises(FileNotFoundError):
        R.read_intervals(spark, f"{folder}/*.none")


def test_index_roundtrip(spark, folder, tmp_path):
    out = str(tmp_path / "index")
    index = build_index(spark, f"{folder}/*.gz", out, payload={"mark": field(F.col("line"), 4)})
    files = index.files().collect()
    assert [(r.file_id, r.num_intervals) for r in files] == [(0, 2), (1, 1), (2, 3), (3, 0)] and files[3].mean_interval_size is None
    assert [r.line.split("\t")[3] for r in Search(index, "1:15-20").records().collect()][:2] == ["p", "q"]
    assert [r.payload.mark for r in Search(index, "1:10-11").records(payload=True).collect()] == ["p"]
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        build_index(spark, f"{folder}/*.gz", out)
    assert build_index(spark, f"{folder}/a*.gz", out, force=True).files().count() == 1
    one = IntervalIndex.load(spark, out).intervals.first().interval_id
    assert IntervalIndex.load(spark, out).lookup(one).count() == 1


def test_metadata(spark):
    conf = M.parse_conf(CONF)
    d = spark.createDataFrame([("\t".join(x.split()),) for x in META], "line string").withColumn("meta", M.typed(F.col("line"), conf))
    assert d.collect()[3].meta.feature == "qrstuvwxyz"
    keep = lambda w: [r.line.split("\t")[0] for r in d.where(M.parse_where(conf, w)).collect()]
    assert keep("feature<my_feature") == ["100", "200", "250"]
    assert keep("score>=456.5") == ["300"] and keep("strand==+") == ["100", "250"] and keep("is_important!=1") == ["200", "250"]
    for bad in ("score=5", "none==1", "score", "=="):
        with pytest.raises(ValueError):
            M.parse_where(conf, bad)
    for bad in ("0 a int_8", "1 a int_9", "1 a string", "1 a string 255", "1 a int_8\n2 a int_8", "1 " + "a" * 32 + " int_8"):
        with pytest.raises(ValueError):
            M.parse_conf(bad)


def test_side_tables(spark, tmp_path):
    (tmp_path / "g.genome").write_text("chr1\t100\nchr2\t50\n")
    assert R.genome_size(R.read_genome(spark, str(tmp_path / "g.genome"))) == 150
    (tmp_path / "m.json").write_text(json.dumps({"dimensions": [{"elements": ["r0", "r1"]}, {"elements": ["c0"]}], "sourceFiles": [{"name": "x", "position": [1, 0]}]}))
    files, labels = R.read_matrix_definition(spark, str(tmp_path / "m.json"))
    assert tuple(files.first()) == ("x", 1, 0) and labels.count() == 3
    ddl = "CREATE TABLE `t` (\n `bin` int,\n `tName` varchar(255),\n `tStart` int,\n `tEnd` int,\n KEY `k` (`bin`)\n) ENGINE=X;"
    assert R.pick_columns(R.columns_of_ddl(ddl), R.TRACK_COLUMNS) == {"chrom": "tName", "start": "tStart", "end": "tEnd"}
    with pytest.raises(ValueError):
        R.pick_columns(["a"], R.TRACK_COLUMNS)
    d = spark.createDataFrame([("1", 5, 9, "s"), ("1", 1, 2, "s"), ("2", 3, 4, "t")], "chrom string, start bigint, end bigint, state string")
    R.write_bed(d, str(tmp_path / "out"), ["state"])
    assert [r.value for r in spark.read.text(str(tmp_path / "out" / "state=s")).collect()] == ["1\t1\t2", "1\t5\t9"]


def test_command_line(spark, folder, tmp_path):
    out = io.StringIO()
    assert cli.main(["index", "-i", f"{folder}/*.gz", "-o", str(tmp_path / "i")], spark, out) == 0
    for mode, args in (("counts", ["-r", "1:1-50"]), ("significance", ["-q", f"{folder}/b.bed.gz"]), ("records", ["-q", f"{folder}/a.bed.gz"]), ("grouped", ["-q", f"{folder}/a.bed.gz"]), ("list", ["-r", "1:1-2"])):
        assert cli.main(["search", "-i", str(tmp_path / "i"), "--mode", mode, *args], spark, out) == 0
    text = out.getvalue()
    assert "Indexed 6 intervals." in text and "overlaps:2" in text and "#file\tfile_size" in text
    with pytest.raises(SystemExit):
        cli.main(["search", "-i", str(tmp_path / "i"), "--mode", "significance", "-r", "1:1-2"], spark, out)


def test_server(spark, folder, tmp_path):
    build_index(spark, f"{folder}/*.bed.gz", str(tmp_path / "i"))
    s = server.serve(spark, str(tmp_path / "i"), 0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{s.server_port}/"
    get = lambda q: urllib.request.urlopen(url + q).read().decode()
    assert "overlaps:2" in get("?region=1:1-50") and "a.bed.gz" in get("?region=1:1-50&full")
    urllib.request.urlopen(urllib.request.Request(url + "?name=u.bed", data=b"1\t1\t500\n", method="POST"))
    assert "fishers_two_tail" in get("?query=u.bed&files=a.bed")
    with pytest.raises(urllib.error.HTTPError):
        get("?nothing=1")
    s.shutdown()


def test_stream(spark, folder, tmp_path):
    index = build_index(spark, f"{folder}/*.bed.gz", str(tmp_path / "i"))
    spark.createDataFrame([("chr1", 12, 16), ("1", 1, 900000000)], "chrom string, start bigint, end bigint").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = spark.readStream.schema("chrom string, start bigint, end bigint").parquet(str(tmp_path / "in"))
    run = stream_counts(q, index.intervals.select("chrom", "start", "end", "level", "bin", "file_id"), str(tmp_path / "out"), str(tmp_path / "check"))
    run.awaitTermination(120)
    got = {r.file_id: r.overlaps for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: 4, 1: 1}


def test_grouped_report_and_append(spark, folder, tmp_path):
    """One header a query line in the queries' order, equal lines apart; an appended file's ids follow those of the index."""
    (tmp_path / "q.bed").write_text("1\t15\t18\n2\t1\t2\n1\t15\t18\n1\t100\t110\n")
    build_index(spark, f"{folder}/a.bed.gz", str(tmp_path / "i"))
    build_index(spark, f"{folder}/b.bed.gz").append(str(tmp_path / "i"))
    index = IntervalIndex.load(spark, str(tmp_path / "i"))
    assert sorted((r.file_id, r.row_ord, r.interval_id) for r in index.intervals.collect()) == [(0, 2, 2), (0, 3, 3), (1, 0, 1 << 40)]
    out = io.StringIO()
    cli.main(["search", "-i", str(tmp_path / "i"), "--mode", "grouped", "-q", str(tmp_path / "q.bed")], spark, out)
    lines = [x.rsplit("/", 1)[-1] for x in out.getvalue().splitlines()]
    assert lines == ["##1\t15\t18", "a.bed.gz\t2", "##1\t15\t18", "a.bed.gz\t2", "##1\t100\t110", "b.bed.gz\t1"]
    out = io.StringIO()
    cli.main(["search", "-i", str(tmp_path / "i"), "--mode", "grouped", "-r", "1:100-110,1:15-18"], spark, out)
    assert [x for x in out.getvalue().splitlines() if x.startswith("##")] == ["##1:100-110", "##1:15-18"]
    with pytest.raises(ValueError):
        build_index(spark, f"{folder}/b.bed.gz", conf=M.parse_conf("4 x int_8")).append(str(tmp_path / "i"))


def test_line_numbers_do_not_hang_on_splits(spark, tmp_path):
    (tmp_path / "long.bed").write_text("".join(f"1\t{i}\t{i + 5}\t{'x' * (i % 90)}\n" for i in range(20_000)))
    (tmp_path / "other.bed").write_text("".join(f"2\t{i}\t{i + 5}\n" for i in range(500)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("50000", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = R.read_intervals(spark, f"{tmp_path}/*.bed").intervals
            assert rows.where("start <> row_ord").isEmpty() and rows.count() == 20_500
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
