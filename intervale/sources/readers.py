"""Reading interval files: BED and VCF text, plain, gzipped or in blocked gzip, by suffix and glob; and the small side tables."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from intervale.functions.scalars import field, integer, normalize_chrom
from intervale.sources import bgzf


@dataclass
class Corpus:
    """``intervals``: file_name, chrom, start, end, line, row_ord; ``rejects``: file_name, line, reason; ``names``: every file
    that was opened, empty ones too."""

    intervals: DataFrame
    rejects: DataFrame
    names: DataFrame


def file_format(path: str) -> str:
    """``bed`` or ``vcf`` by the name's suffix; other names are an error."""
    for kind in ("bed", "vcf"):
        if path.endswith((f".{kind}", f".{kind}.gz")):
            return kind
    raise ValueError(f"neither a BED nor a VCF file by its name: {path}")


def list_files(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files a glob matches, sorted by path, on any file system Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted((x.getPath().toString(), int(x.getLen())) for x in found or [] if x.isFile())


def _uri(path: Column) -> Column:
    """Local paths in one form, however they were listed."""
    return F.regexp_replace(path, "^(file:)?/+", "file:///")


def _lines(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """file_name, line, row_ord: the line's number in its file from 0, whichever splits the file is read in. Blocked gzip files
    larger than a range are read in ranges, other ``.gz`` files whole.

    Lines are numbered within their split by the scan; a first pass counts the lines of each split, and the sums before it, a row a
    split (at 128 MB, 800 thousand rows for 100 TB), are broadcast.
    """
    split = bgzf.range_bytes(spark, files)
    ranged = bgzf.blocked(spark, files, split)
    parts, splits = [], []
    if whole := [p for p, n in files if (p, n) not in ranged]:
        text = spark.read.text(whole)
        path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # a URI; files are listed as paths
        parts.append(text.select(_uri(path).alias("file_name"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("place")))
        splits.append(parts[0].groupBy(F.col("file_name").alias("s_file"), F.col("block").alias("s_block")).agg(F.min("place").alias("first"), F.count("*").alias("n")))
    if ranged:
        ranged = [(re.sub("^(file:)?/+", "file:///", p), n) for p, n in ranged]  # as by ``_uri``, once a file
        parts.append(bgzf.read_lines(spark, ranged, split))
        splits.append(bgzf.count_lines(spark, ranged, split).select(F.col("file_name").alias("s_file"), F.col("block").alias("s_block"), F.lit(0).cast("long").alias("first"), "n"))
    rows, splits = (x[0] if len(x) == 1 else x[0].union(x[1]) for x in (parts, splits))
    before = Window.partitionBy("s_file").orderBy("s_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shift = splits.select("s_file", "s_block", (F.sum("n").over(before) - F.col("n") - F.col("first")).alias("shift"))
    rows = rows.join(F.broadcast(shift), (F.col("file_name") == F.col("s_file")) & (F.col("block") == F.col("s_block")))
    return rows.select("file_name", "line", (F.col("place") + F.col("shift")).alias("row_ord"))


def _bed(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    named = (line.startswith("track") | line.startswith("browser")) & line.rlike(r"^(track\b|browser\b)")
    part = lambda n: F.split_part(line, F.lit("\t"), F.lit(n))  # noqa: E731  empty beyond the last
    return lines.where(~(line.startswith("#") | named | (F.trim(line) == ""))).select("*", normalize_chrom(part(1)).alias("chrom"), integer(part(2)).alias("start"), integer(part(3)).alias("end"))


def vcf_end(position: Column, ref: Column, info: Column) -> Column:
    """INFO/END + 1; else position - 1 + |INFO/SVLEN| + 1; else position - 1 + length of the reference allele + 1."""
    tag = lambda name: integer(F.regexp_extract(info, rf"(?:^|;){name}=(-?\d+)", 1))
    return F.coalesce(tag("END") + 1, position + F.abs(tag("SVLEN")), position + F.length(ref))


def _vcf(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    start = integer(field(line, 2))
    return lines.where(~line.startswith("#") & (F.trim("line") != "")).select("*", normalize_chrom(field(line, 1)).alias("chrom"), start.alias("start"), vcf_end(start, field(line, 4), F.coalesce(field(line, 8), F.lit(""))).alias("end"))


def read_intervals(spark: SparkSession, pattern: str) -> Corpus:
    """All BED and VCF files a glob matches. Rows without three usable columns, or that end before they start, are rejects."""
    files = list_files(spark, pattern)
    if not files:
        raise FileNotFoundError(pattern)
    parts = []
    for kind, parse in (("bed", _bed), ("vcf", _vcf)):
        if own := [(p, n) for p, n in files if file_format(p) == kind]:
            parts.append(parse(_lines(spark, own)))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    short = F.col("chrom").isNull() | F.col("start").isNull() | F.col("end").isNull()
    reason = F.when(short, "columns").when(F.col("end") < F.col("start"), "inverted")
    rows = rows.withColumn("reason", reason)
    good = rows.where("reason IS NULL").select("file_name", "chrom", "start", "end", "line", "row_ord")
    names = spark.createDataFrame([(p,) for p, _ in files], "file_name string")
    return Corpus(good, rows.where("reason IS NOT NULL").select("file_name", "line", "reason"), names.withColumn("file_name", _uri(F.col("file_name"))))


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    """chrom, length from a tab-separated genome file."""
    return spark.read.schema("chrom string, length bigint").csv(path, sep="\t")


def genome_size(genome: DataFrame) -> int:
    return int(genome.agg(F.sum("length")).first()[0] or 0)


def read_matrix_definition(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(source_files: file_name, row, col; labels: dimension, position, label) from a JSON definition of a matrix."""
    j = spark.read.option("multiLine", True).json(path)
    files = j.select(F.explode("sourceFiles").alias("f")).select(F.col("f.name").alias("file_name"), F.get("f.position", F.lit(0)).alias("row"), F.get("f.position", F.lit(1)).alias("col"))
    labels = j.select(F.posexplode("dimensions").alias("dimension", "d")).select("dimension", F.posexplode("d.elements").alias("position", "label"))
    return files, labels


def pick_columns(names: list[str], families: list[dict[str, str]]) -> dict[str, str]:
    """The columns of the first family of names that a table has all of; start and end are never of two families. None is an
    error."""
    have = {n.lower(): n for n in names}
    for family in families:
        if all(name.lower() in have for name in family.values()):
            return {wanted: have[name.lower()] for wanted, name in family.items()}
    raise ValueError(f"no columns for an interval among {names}")


#: Names under which published track tables keep chromosome, start and end, in order of preference.
TRACK_COLUMNS = [
    {"chrom": "chrom", "start": "chromStart", "end": "chromEnd"},
    {"chrom": "chrom", "start": "txStart", "end": "txEnd"},
    {"chrom": "tName", "start": "tStart", "end": "tEnd"},
    {"chrom": "genoName", "start": "genoStart", "end": "genoEnd"},
]


def columns_of_ddl(ddl: str) -> list[str]:
    """Column names of a CREATE TABLE text, in order."""
    import re

    body = ddl[ddl.index("(") + 1 : ddl.rindex(")")]
    keys = ("PRIMARY", "KEY", "UNIQUE", "INDEX", "CONSTRAINT", "FULLTEXT")
    lines = [x.strip() for x in body.split("\n")]
    return [m[1] for x in lines if not x.upper().startswith(keys) and (m := re.match(r"`?(\w+)`?\s+\w", x))]


def write_bed(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Sorted tab-separated text, compressed; with ``by``, a folder for each value, as a split writer, written by as many tasks as
    the value has chromosomes."""
    order = [*(by or []), "chrom", "start", "end"]
    rows = df.repartition(*by, "chrom") if by else df.repartitionByRange("chrom", "start", "end")
    rows = rows.sortWithinPartitions(*order)
    text = F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"))
    out = rows.select(*(by or []), text.alias("value")).write.option("compression", "gzip")
    (out.partitionBy(*by) if by else out).text(path)


def write_named(lines: DataFrame, folder: str, suffix: str, name: str = "file_name", line: str = "line", order: list[str] | None = None) -> None:
    """One blocked gzip text file ``<name><suffix>`` below ``folder`` for each value of ``name``, its lines in ``order``: as the indexer
    reads them. Rows are dealt by ranges of name and order, so a file is sorted and packed by as many tasks as it is long, through
    Spark's committed text writer (a member's last byte, zero, is the separator); one task a file only copies the packed bytes."""
    spark = lines.sparkSession
    by = ["name", *(order or ["value"])]
    rows = lines.withColumns({"name": F.col(name), "value": F.col(line)}).select(*dict.fromkeys([*by, "value"]))
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("name", "value")
    packed = rows.mapInArrow(bgzf.pack, "name string, number bigint, value binary").sortWithinPartitions("name", "number")
    packed.select("name", F.col("value").cast("string").alias("value")).write.partitionBy("name").option("lineSep", "\0").text(f"{folder}/_parts")
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_parts")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = []
    for d in fs.listStatus(root):
        if d.isDirectory():
            found = [x.getPath() for x in fs.listStatus(d.getPath()) if x.getPath().getName().startswith("part-")]
            found.sort(key=lambda x: (int(x.getName().split("-")[1]), x.getName()))  # by the tasks' numbers, which are the ranges'
            parts.append((d.getPath().getName().split("=", 1)[1], [x.toString() for x in found]))
    for value, path in bgzf.join_parts(spark, parts, f"{folder}/_parts").items():
        fs.rename(spark._jvm.org.apache.hadoop.fs.Path(path), spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{value}{suffix}"))
    fs.delete(root, True)


def ordered_ids(names: DataFrame) -> DataFrame:
    """file_name with file_id, dense from 0 in order of the names. One row a file, so the window without a key is small."""
    return names.select("file_name").distinct().withColumn("file_id", (F.row_number().over(Window.orderBy("file_name")) - 1).cast("long"))
