"""Operators that prepare corpora and lay out results: dictionary and list joins, pivots, top-k, trends, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intervale.operators.overlap import RANGE_BITS


def dictionary_join(df: DataFrame, names: DataFrame, key: str, code: str = "code", strict: bool = False) -> DataFrame:
    """Names for codes, an inner join; ``strict``: codes without a name are an error when the rows are read."""
    n = names.withColumnRenamed(code, "_code")
    if not strict:
        return df.join(n, F.col(key) == F.col("_code")).drop("_code")
    out = df.join(n, F.col(key) == F.col("_code"), "left")
    checked = F.when(F.col("_code").isNull(), F.raise_error(F.concat(F.lit("no name for "), F.col(key).cast("string")))).otherwise(F.col(key))
    return out.withColumn(key, checked).drop("_code")


def keep_listed(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids, key, "left_semi")


def drop_listed(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids, key, "left_anti")


def longest_match(df: DataFrame, labels: DataFrame, name: str, label: str, most: int = 10_000) -> DataFrame:
    """``df`` with the longest label its name contains, or null. Labels are a dictionary of at most ``most`` rows, held in one
    array literal and searched in each row, so names never meet labels in a join."""
    found = [r[0] for r in labels.select(label).where(F.col(label).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} labels")
    ordered = sorted(found, key=lambda x: (-len(x), x))
    if not ordered:
        return df.withColumn(label, F.lit(None).cast("string"))
    return df.withColumn(label, F.get(F.filter(F.lit(ordered), lambda x: F.contains(F.col(name), x)), F.lit(0)))


def pivot_matrix(df: DataFrame, row: str, column: str, value: str, values: list[str], fill: float | None = 0) -> DataFrame:
    """A row for each ``row`` and a column for each of ``values``, missing cells ``fill``; of cells that repeat the least value."""
    out = df.groupBy(row).pivot(column, values).agg(F.min(value))
    return out if fill is None else out.fillna(fill, values)


def unpivot_nonzero(df: DataFrame, ids: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(ids, columns, name, value).where(F.col(value) != 0)


def top_k(df: DataFrame, by: Column, k: int) -> DataFrame:
    return df.orderBy(by).limit(k)


def running_number(df: DataFrame, prefix: Column, *order: str, name: str = "number") -> DataFrame:
    """From 0 within each prefix."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(prefix).orderBy(*order)) - 1)


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """slope and intercept of the least-squares line."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def union_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def difference_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, a.columns, "left_anti").distinct()


def collect_per_group(df: DataFrame, keys: list[str], value: str, name: str = "values") -> DataFrame:
    """Sorted values of each group; for groups as small as a record's repeats."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(name))


def point_to_interval(df: DataFrame, position: str = "pos") -> DataFrame:
    return df.select("chrom", F.col(position).alias("start"), (F.col(position) + 1).alias("end"))


def random_intervals(spark, n: int, length: int, genome: DataFrame, seed: int = 1) -> DataFrame:
    """n intervals of one length, uniform over the chromosomes of ``genome`` (chrom, length) that hold it.

    The genome, a few rows, is one array of cumulative lengths. Positions come from a digest of seed and number, so they are the same
    however the rows are dealt.
    """
    g = genome.where(F.col("length") > length).select("chrom", (F.col("length") - length).alias("room"))
    rows = sorted(g.collect())
    cells, total = [], 0
    for chrom, room in rows:
        cells.append(F.struct(F.lit(chrom).alias("chrom"), F.lit(total).cast("long").alias("lo"), F.lit(total + room).cast("long").alias("hi")))
        total += room
    at = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "id").cast("binary")), 1, 13), 16, 10).cast("long"), F.lit(total))
    cell = F.get(F.filter(F.array(*cells), lambda c: (c["lo"] <= F.col("at")) & (F.col("at") < c["hi"])), F.lit(0))
    d = spark.range(n).withColumn("at", at).withColumn("cell", cell)
    return d.select(F.col("cell.chrom").alias("chrom"), (F.col("at") - F.col("cell.lo")).alias("start"), (F.col("at") - F.col("cell.lo") + length).alias("end"))


def coverage_depth(intervals: DataFrame, bits: int = RANGE_BITS) -> DataFrame:
    """chrom, start, end, depth: stretches of positions with as many intervals over them, from 1 on; closed at both ends.

    Positions are cut into ranges of 2**bits; what is open before a range comes from sums by range, so a chromosome is swept by as
    many tasks as it has ranges. The ranges, a row each and so no more than the genome's length over 2**bits, are broadcast.
    """
    points = intervals.where("start <= end").select("chrom", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("end") + 1).alias("pos"), F.lit(-1).alias("d")))).alias("x"))
    points = points.groupBy("chrom", "x.pos").agg(F.sum("x.d").alias("d"))
    points = points.withColumn("part", F.shiftright("pos", bits))
    parts = points.groupBy("chrom", "part").agg(F.sum("d").alias("d"), F.min("pos").alias("first"))
    by = Window.partitionBy("chrom").orderBy("part")
    base = F.sum("d").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("d")
    parts = parts.select("chrom", "part", base.alias("base"), F.lead("first").over(by).alias("after"))
    w = Window.partitionBy("chrom", "part").orderBy("pos")
    out = points.withColumns({"open": F.sum("d").over(w), "next": F.lead("pos").over(w)}).join(F.broadcast(parts), ["chrom", "part"])
    out = out.select("chrom", F.col("pos").alias("start"), (F.coalesce("next", "after") - 1).alias("end"), (F.col("open") + F.col("base")).alias("depth"))
    return out.where("depth > 0")
