"""The interval index: a folder of Parquet tables, built from files or rows, loaded lazily."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.operators.enrich import file_statistics
from intervale.operators.overlap import bin_columns, corpus_levels
from intervale.sources.metadata import MetaColumn, typed
from intervale.sources.readers import Corpus, ordered_ids, read_intervals
from intervale.tables import shared_dir

__all__ = ["IntervalIndex", "build_index", "from_rows", "merge", "shared_dir"]


#: Bits of an interval id below the file's number: the line's number in its file.
LINE_BITS = 40
#: Files up to which their table is broadcast; above it hits meet names by a shuffle.
MOST_FILES = 1_000_000


class IntervalIndex:
    """``intervals``: interval_id (the file's number and the line's, so it is the same however the files are read), file_id, chrom, start, end, level, bin, row_ord, line, and ``meta`` and ``payload`` where given;
    ``files``: file_id, file_name, num_intervals, mean_interval_size; ``conf``: the metadata declarations."""

    def __init__(self, intervals: DataFrame, files: DataFrame, conf: list[MetaColumn] | None = None):
        self.intervals, self._files, self.conf = intervals, files, conf or []
        self._n_files: int | None = None
        self._levels: dict[int, int] | None = None
        self._names: DataFrame | None = None  # where ``files`` would read the corpus once more

    def n_files(self) -> int:
        if self._n_files is None:
            self._n_files = self._files.select("file_id").count()
        return self._n_files

    def levels(self) -> dict[int, int]:
        """Intervals by level, counted once."""
        if self._levels is None:
            self._levels = corpus_levels(self.intervals)
        return self._levels

    def small(self, rows: DataFrame) -> DataFrame:
        """Rows a file, broadcast if there are few files."""
        return F.broadcast(rows) if self.n_files() <= MOST_FILES else rows

    def files(self) -> DataFrame:
        return self._files.orderBy("file_id")

    def chroms(self) -> DataFrame:
        return self.intervals.groupBy("chrom").agg(F.count("*").alias("num_intervals"))

    def metadata(self) -> DataFrame:
        return self.intervals.select("interval_id", "meta.*")

    def lookup(self, interval_id: int) -> DataFrame:
        """File and line of one interval; the scan gets the file's number and the line's as filters."""
        one = self.intervals.where((F.col("file_id") == interval_id >> LINE_BITS) & (F.col("row_ord") == interval_id & (1 << LINE_BITS) - 1))
        return one.join(self.small(self._files.select("file_id", "file_name")), "file_id").select("interval_id", "file_name", "row_ord", "line")

    def append(self, path: str, compression: str = "zstd") -> None:
        """Add this corpus to the index saved below ``path``: its files follow those, and only the new rows are written. Metadata
        must be declared alike."""
        spark = self.intervals.sparkSession
        there = IntervalIndex.load(spark, path)
        if there.conf != self.conf:
            raise ValueError("other metadata declarations than the index has")
        last = there._files.agg(F.max("file_id")).first()[0]
        base = 0 if last is None else int(last) + 1
        shift = (F.col("file_id") + base).alias("file_id")
        rows = self.intervals.withColumn("interval_id", F.col("interval_id") + (base << LINE_BITS)).withColumn("file_id", shift)
        self._write(rows.select(*there.intervals.columns), f"{path}/intervals", "append", compression)
        self._files.withColumn("file_id", shift).coalesce(1).write.mode("append").parquet(f"{path}/files")

    @staticmethod
    def _write(rows: DataFrame, path: str, mode: str, compression: str) -> None:
        rows = rows.repartition("chrom", F.shiftright("start", 24)).sortWithinPartitions("chrom", "start", "end")
        rows.write.mode(mode).partitionBy("chrom").option("compression", compression).parquet(path)

    def save(self, path: str, force: bool = False, compression: str = "zstd") -> None:
        """Write below ``path``: intervals partitioned by chromosome, sorted in each file by start and end so that row groups can
        be passed over. Rows of a chromosome are dealt by bin as well, so a large one is many tasks. An existing index is
        an error without ``force``; with it, the new one is written beside and takes its place whole. ``compression``: any that
        Parquet knows, ``none`` too."""
        spark = self.intervals.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(target) and not force:
            raise FileExistsError(f"{path} already exists")
        beside = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
        self._write(self.intervals, f"{beside}/intervals", "errorifexists", compression)
        files = self._files
        if self._names is not None:  # statistics of what was written, so that the corpus is read once
            files = _counted(self._names, spark.read.schema(self.intervals.schema).parquet(f"{beside}/intervals"), "file_id")
        files.coalesce(1).write.parquet(f"{beside}/files")
        conf = json.dumps([[c.position, c.name, c.kind, c.size] for c in self.conf])
        spark.createDataFrame([(conf,)], "value string").coalesce(1).write.text(f"{beside}/conf")
        fs.delete(target, True)
        if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(beside), target):
            raise OSError(f"{beside} could not be moved to {path}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> IntervalIndex:
        conf = json.loads(spark.read.text(f"{path}/conf").first()[0])
        raw = spark.read.parquet(f"{path}/intervals")
        rows = spark.read.schema(raw.withColumn("chrom", F.col("chrom").cast("string")).schema).parquet(f"{path}/intervals")  # names of digits stay text
        return IntervalIndex(rows, spark.read.parquet(f"{path}/files"), [MetaColumn(*c) for c in conf])


def from_corpus(corpus: Corpus, conf: list[MetaColumn] | None = None, payload: dict[str, Column] | None = None) -> IntervalIndex:
    names = ordered_ids(corpus.names)
    n_files = names.count()
    rows = corpus.intervals.join(F.broadcast(names) if n_files <= MOST_FILES else names, "file_name")
    rows = bin_columns(rows).withColumn("interval_id", F.shiftleft("file_id", LINE_BITS) + F.col("row_ord"))
    extra = [typed(F.col("line"), conf).alias("meta")] if conf else []
    if payload:
        extra.append(F.struct(*(c.alias(n) for n, c in payload.items())).alias("payload"))
    files = _counted(names, corpus.intervals, "file_name")
    out = IntervalIndex(rows.select("interval_id", "file_id", "chrom", "start", "end", "level", "bin", "row_ord", "line", *extra), files, conf)
    out._n_files, out._names = n_files, names
    return out


def _counted(names: DataFrame, intervals: DataFrame, by: str) -> DataFrame:
    """Every file of ``names`` with the statistics of its intervals."""
    stats = file_statistics(intervals, by).withColumnRenamed(by, "_f")
    return names.join(stats, F.col(by) == F.col("_f"), "left").select("file_id", "file_name", F.coalesce("num_intervals", F.lit(0)).cast("long").alias("num_intervals"), "mean_interval_size")


def build_index(spark: SparkSession, pattern: str, out: str | None = None, conf: list[MetaColumn] | None = None, force: bool = False, payload: dict[str, Column] | None = None) -> IntervalIndex:
    """The index of all files a glob matches. ``conf``: typed metadata of the lines; ``payload``: columns computed from ``line``
    and kept with each interval; ``out``: where it is saved and loaded from again."""
    index = from_corpus(read_intervals(spark, pattern), conf, payload)
    if out is None:
        return index
    index.save(out, force)
    return IntervalIndex.load(spark, out)


def from_rows(spark: SparkSession, rows: list[tuple], conf: list[MetaColumn] | None = None) -> IntervalIndex:
    """An index of a few rows (file_name, chrom, start, end[, line]), for tests and small sets."""
    full = [(r[0], r[1], r[2], r[3], r[4] if len(r) > 4 else f"{r[1]}\t{r[2]}\t{r[3]}", i) for i, r in enumerate(rows)]
    df = spark.createDataFrame(full, "file_name string, chrom string, start bigint, end bigint, line string, row_ord bigint")
    df = df.withColumn("chrom", F.regexp_replace("chrom", "^chr", ""))
    return from_corpus(Corpus(df, df.where("false"), df.select("file_name").distinct()), conf)


def merge(a: IntervalIndex, b: IntervalIndex) -> IntervalIndex:
    """Both corpora as one: the second's file ids, and with them its interval ids, follow the first's."""
    base = a.n_files()
    shift = (F.col("file_id") + base).alias("file_id")
    intervals = a.intervals.unionByName(b.intervals.withColumn("file_id", shift).withColumn("interval_id", F.col("interval_id") + (base << LINE_BITS)), allowMissingColumns=True)
    return IntervalIndex(intervals, a._files.unionByName(b._files.withColumn("file_id", shift)), a.conf or b.conf)
