"""Searching an index: hits, counts, records, grouped counts and significance, as DataFrames or text reports."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intervale.functions.scalars import Region, matches_any, normalize_chrom, parse_regions
from intervale.operators import enrich
from intervale.operators.overlap import MOST_LITERALS, count_pairs, count_rank, overlap
from intervale.plans.index import IntervalIndex
from intervale.schema import GENOME_SIZE
from intervale.sources.metadata import parse_where

Queries = str | list[Region] | DataFrame


class Search:
    """A query set against an index. ``queries``: regions as text or parsed, or rows (chrom, start, end, more); ``where``: one
    metadata predicate; ``files``: basic regular expressions, of which a file's name must match one.

    The predicate filters hits before the join and leaves file sizes as they are. File patterns filter files before the
    join too, since all results are per file.
    """

    def __init__(self, index: IntervalIndex, queries: Queries, where: str | Column | None = None, files: list[str] | None = None, strategy: str | None = None):
        self.index, self.strategy = index, strategy
        self.queries = parse_regions(queries) if isinstance(queries, str) else queries
        if isinstance(self.queries, DataFrame):
            self.queries = self.queries.withColumn("chrom", normalize_chrom(F.col("chrom")))
        self.where = parse_where(index.conf, where) if isinstance(where, str) else where
        self.file_rows = index.files().where(matches_any(F.col("file_name"), files or []))
        self.limited = bool(files)

    def _corpus(self, *columns: str) -> DataFrame:
        c = self.index.intervals if self.where is None else self.index.intervals.where(self.where)
        if self.limited:
            c = c.join(self.index.small(self.file_rows.select("file_id")), "file_id", "left_semi")
        return c.select("chrom", "start", "end", "level", "bin", "file_id", *columns)

    def _query_rows(self) -> DataFrame:
        if isinstance(self.queries, DataFrame):
            return self.queries
        return self.index.intervals.sparkSession.createDataFrame([(r.chrom, r.start, r.end) for r in self.queries], "chrom string, start bigint, end bigint")

    def hits(self, *columns: str) -> DataFrame:
        """A row for each pair of a query and an interval it meets, as a bag."""
        literal = isinstance(self.queries, list) and len(self.queries) <= MOST_LITERALS
        levels = None if literal or self.strategy == "naive" else self.index.levels()
        return overlap(self.queries, self._corpus(*columns), self.strategy if self.strategy != "rank" else None, levels)

    def removed(self) -> DataFrame:
        """One row (hits, kept, removed): what the metadata predicate left of all hits."""
        count = lambda s: s.counts().agg(F.coalesce(F.sum("overlaps"), F.lit(0)).alias("n"))
        every = Search(self.index, self.queries, None, None, self.strategy)
        every.file_rows, every.limited = self.file_rows, self.limited
        both = count(every).select(F.col("n").alias("hits")).join(F.broadcast(count(self).select(F.col("n").alias("kept"))))  # one row each
        return both.select("hits", "kept", (F.col("hits") - F.col("kept")).alias("removed"))

    def first(self, n: int) -> DataFrame:
        """The first n records, in the files' and lines' order."""
        return self.records().limit(n)

    def __getitem__(self, file_id: int) -> Iterator[str]:
        """Lines of the hits in one file, as bindings index their results."""
        return (r["line"] for r in self.hits("line", "row_ord").where(F.col("file_id") == file_id).orderBy("row_ord").select("line").toLocalIterator())

    def total(self) -> int:
        """Number of hits."""
        return int(self.counts().agg(F.sum("overlaps")).first()[0] or 0)

    def counts(self) -> DataFrame:
        """file_id, file_name, num_intervals, mean_interval_size, overlaps for every file, zeros too."""
        few = isinstance(self.queries, list) and len(self.queries) <= MOST_LITERALS
        if self.strategy == "rank" or self.strategy is None and not few:
            n = count_rank(self._query_rows().select("chrom", "start", "end"), self._corpus(), ["file_id"])
        else:
            n = count_pairs(self.hits(), ["file_id"])
        return enrich.with_zeros(self.file_rows, n, "file_id")

    def records(self, payload: bool = False) -> DataFrame:
        """line, file_name (and payload) of each hit, in the files' and lines' order."""
        extra = ["payload"] if payload else []
        named = self.hits("line", "row_ord", *extra).join(self.index.small(self.file_rows.select("file_id", "file_name")), "file_id")
        return named.orderBy("file_id", "row_ord").select("line", "file_name", *extra)

    def iterate(self) -> Iterator[tuple[str, str]]:
        """Records one by one, a partition at a time on the driver."""
        for row in self.records().toLocalIterator():
            yield row["line"], row["file_name"]

    def grouped(self, *keys: str) -> DataFrame:
        """(``keys``..., file_id, file_name, overlaps) for each query with hits; ``keys``: columns that tell the queries apart, by
        default ``qid``."""
        keys = keys or ("qid",)
        n = self.hits().groupBy(*(F.col(f"q_{k}").alias(k) for k in keys), "file_id").agg(F.count("*").alias("overlaps"))
        return n.join(self.index.small(self.file_rows.select("file_id", "file_name")), "file_id").select(*keys, "file_id", "file_name", "overlaps")

    def nonempty(self) -> DataFrame:
        return self.counts().where("overlaps > 0")

    def significance(self, genome_size: float = GENOME_SIZE) -> DataFrame:
        """The report of eight columns, a row for each file."""
        return enrich.report(enrich.contingency(self.counts(), self._query_rows(), genome_size))


def all_against_all(query_sets: DataFrame, index: IntervalIndex, genome_size: float = GENOME_SIZE) -> DataFrame:
    """One job for many query files: rows (query_file, chrom, start, end) give a significance report with a column query_file."""
    q = query_sets.select("query_file", normalize_chrom(F.col("chrom")).alias("chrom"), "start", "end")
    pairs = overlap(q, index.intervals.select("chrom", "start", "end", "level", "bin", "file_id"), levels=index.levels())
    n = pairs.groupBy("q_query_file", "file_id").agg(F.count("*").alias("overlaps"))
    sets = q.groupBy("query_file").agg(F.count("*").alias("q_n"), F.avg(F.col("end") - F.col("start")).alias("q_mean"))
    grid = sets.join(index.small(index.files()))  # a row for each query file and indexed file: the result's own shape
    t = grid.join(n.withColumnRenamed("file_id", "_f"), (F.col("query_file") == F.col("q_query_file")) & (F.col("file_id") == F.col("_f")), "left")
    t = t.withColumn("overlaps", F.coalesce("overlaps", F.lit(0)).cast("long"))
    return table_of(t, genome_size)


def table_of(t: DataFrame, genome_size: float) -> DataFrame:
    """Rows with q_n, q_mean, num_intervals, mean_interval_size and overlaps, scored."""
    from intervale.functions.scalars import safe_subtract

    t = t.withColumn("n11", F.col("overlaps")).withColumn("n12", safe_subtract(F.col("q_n"), F.col("n11"))).withColumn("n21", safe_subtract(F.col("num_intervals"), F.col("n11")))
    known = F.col("n11") + F.col("n12") + F.col("n21")
    room = F.try_divide(F.lit(float(int(genome_size))), F.col("mean_interval_size") + F.col("q_mean"))
    t = t.withColumn("n22", safe_subtract(F.greatest(known.cast("double"), F.coalesce(room, F.lit(0.0))).cast("bigint"), known))
    return enrich.significance(t).select("query_file", "file_name", F.col("num_intervals").alias("file_size"), *enrich.REPORT[2:])


def count_text(counts: DataFrame) -> Iterator[str]:
    for r in counts.orderBy("file_id").toLocalIterator():
        yield f"#{r['file_name']}\tsize:{r['num_intervals']}\toverlaps:{r['overlaps']}"


def grouped_text(grouped: DataFrame, order: str = "ord", line: str = "line") -> Iterator[str]:
    """One header for each query with hits, in the queries' order, with the files it meets below it."""
    last = None
    for r in grouped.orderBy(order, "file_id").toLocalIterator():
        if r[order] != last:
            last = r[order]
            yield f"##{r[line]}"
        yield f"{r['file_name']}\t{r['overlaps']}"


def significance_text(report: DataFrame) -> Iterator[str]:
    yield "#" + "\t".join(("file", *enrich.REPORT[1:]))
    for r in report.toLocalIterator():
        yield "\t".join([r["file_name"], str(r["file_size"]), str(r["overlaps"]), *(f"{r[c]:.17g}" for c in enrich.REPORT[3:])])
