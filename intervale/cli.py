"""Command line: ``index`` builds an index from files, ``search`` queries one."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from intervale.functions.scalars import parse_regions
from intervale.plans import search as plans
from intervale.plans.index import IntervalIndex, build_index
from intervale.schema import GENOME_SIZE
from intervale.sources.metadata import parse_conf
from intervale.sources.readers import read_intervals


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="intervale")
    verbs = p.add_subparsers(dest="verb", required=True)
    i = verbs.add_parser("index", help="index all files a glob matches")
    i.add_argument("-i", dest="input", required=True)
    i.add_argument("-o", dest="output", required=True)
    i.add_argument("-m", dest="metadata", help="file of metadata declarations")
    i.add_argument("-f", dest="force", action="store_true", help="overwrite")
    s = verbs.add_parser("search", help="search an index")
    s.add_argument("-i", dest="index", required=True)
    one = s.add_mutually_exclusive_group(required=True)
    one.add_argument("-r", dest="region", help="regions, separated by commas")
    one.add_argument("-q", dest="query", help="query file")
    s.add_argument("-u", dest="where", help="metadata predicate")
    s.add_argument("-f", dest="files", help="patterns of file names, separated by commas")
    s.add_argument("-g", dest="genome", type=float, default=GENOME_SIZE, help="genome size")
    s.add_argument("--mode", choices=("counts", "records", "grouped", "significance", "list"), default="counts")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("intervale").getOrCreate()
    if a.verb == "index":
        conf = parse_conf("\n".join(r[0] for r in spark.read.text(a.metadata).collect())) if a.metadata else None
        index = build_index(spark, a.input, a.output, conf, a.force)
        print(f"Indexed {index.intervals.count()} intervals.", file=out)
        return 0
    if a.mode == "significance" and not a.query:
        parser().error("significance needs a query file")
    index = IntervalIndex.load(spark, a.index)
    if a.mode == "list":
        for r in index.files().toLocalIterator():
            print(r["file_name"], r["num_intervals"], r["mean_interval_size"], sep="\t", file=out)
        return 0
    if a.query:  # a query file's lines are told apart and ordered by file and line
        queries = read_intervals(spark, a.query).intervals.select("chrom", "start", "end", F.struct("file_name", "row_ord").alias("ord"), "line")
    elif a.mode == "grouped":
        regions = [(r.chrom, r.start, r.end, i, f"{r.chrom}:{r.start}-{r.end}") for i, r in enumerate(parse_regions(a.region))]
        queries = spark.createDataFrame(regions, "chrom string, start bigint, end bigint, ord int, line string")
    else:
        queries = a.region
    s = plans.Search(index, queries, a.where, a.files.split(",") if a.files else None)
    if a.mode == "counts":
        lines = plans.count_text(s.counts())
    elif a.mode == "significance":
        lines = plans.significance_text(s.significance(a.genome))
    elif a.mode == "records":
        lines = (f"{line}\t{name}" for line, name in s.iterate())
    else:
        lines = plans.grouped_text(s.grouped("ord", "line"))
    if a.where:
        r = s.removed().first()
        print(f"{r['removed']} of {r['hits']} hits removed", file=sys.stderr)
    for line in lines:
        print(line, file=out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
