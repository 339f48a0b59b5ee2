"""The interval overlap join: closed intervals of a query set against a corpus, on the same chromosome.

Four physical forms of one predicate. ``literal``: few regions as pushed-down filters. ``binned``: hierarchical bins make it an
equi-join. ``rank``: counts alone, by running sums, without pairs. ``naive``: the definition, for tests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intervale.functions.scalars import Region

#: Bits by which positions are shifted at each level; an interval lies in the lowest level where one bin holds it.
LEVELS = (12, 15, 18, 21, 24, 27, 32, 62)
#: Queries longer than this are wide; they use ranges of as many positions.
WIDE_BITS = 22
WIDE = 1 << WIDE_BITS
#: Intervals of the highest levels, in all, that are broadcast to the queries instead of being met in bins.
FEW = 2048
#: Regions up to which a query set is a filter.
MOST_LITERALS = 100
#: How many bytes of a hashed table a byte of compressed columns may become.
PACKED = 16
#: Positions of one sweep range of ``rank``.
RANGE_BITS = 20


def bin_columns(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """``df`` with ``level`` and ``bin``: one for each interval, however long."""
    level = F.coalesce(*(F.when(F.shiftright(start, k) == F.shiftright(end, k), F.lit(k)) for k in LEVELS))
    return df.withColumn("level", level).withColumn("bin", F.expr(f"shiftright(`{start}`, CAST(level AS INT))"))


def corpus_levels(corpus: DataFrame) -> dict[int, int]:
    """How many intervals lie in each level: a row a level. A saved index has the level as a column of its own."""
    rows = corpus if "level" in corpus.columns else bin_columns(corpus)
    return {r[0]: r[1] for r in rows.groupBy("level").count().collect()}


def split_levels(counts: dict[int, int], few: int = FEW) -> tuple[list[int], list[int]]:
    """(levels met in bins, levels broadcast): from the highest down, those that hold ``few`` intervals together."""
    sparse, total = [], 0
    for k in sorted(counts, reverse=True):
        if total + counts[k] > few:
            break
        sparse.append(k)
        total += counts[k]
    return [k for k in sorted(counts) if k not in sparse], sparse


def _query_bins(start: str, end: str, levels: list[int]) -> Column:
    """Every (level, bin) that intervals overlapping the query may lie in."""
    parts = [f"transform(sequence(shiftright(`{start}`, {k}), shiftright(`{end}`, {k})), b -> struct({k} AS level, b AS bin))" for k in levels]
    return F.expr(f"CASE WHEN `{start}` <= `{end}` THEN concat({', '.join(parts)}) ELSE array() END")


def _renamed(queries: DataFrame) -> DataFrame:
    return queries.select(*(F.col(c).alias(f"q_{c}") for c in queries.columns))


def _dealt(rows: DataFrame, times: int) -> DataFrame:
    """Rows of an ``explode`` that makes some ``times`` as many, for a join by sorting unless they are sure to be few: Spark expects no more
    of them than before, and would broadcast by that what the driver can't hold. Of a stream it knows nothing beforehand."""
    state = rows.sparkSession._jsparkSession.sessionState()
    if not rows.isStreaming:
        size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size * times * PACKED <= state.conf().autoBroadcastJoinThreshold():
            return rows
    return rows.hint("merge")


def overlap_binned(queries: DataFrame, corpus: DataFrame, wide: bool | None = None, levels: dict[int, int] | None = None) -> DataFrame:
    """Pairs, as the query's columns with the prefix ``q_`` and the corpus's columns.

    A corpus interval has one bin, a query meets it in that bin alone, so the equi-join on (chrom, level, bin) needs no
    removal of doubles. Both sides are dealt by bin, of which there are as many as the data is long; those that stand
    out are split at run time. Queries longer than WIDE would lie in very many bins: they meet what covers their start
    through its bins, and what starts further inside through coarse ranges of starts. ``wide``: whether there are such queries;
    None looks. ``levels``: intervals by level; None looks. Queries are dealt over the levels that have intervals, and the
    highest ones, where all queries would share a bin or two to meet next to nothing, are at most FEW rows that are broadcast.
    """
    c = corpus if {"level", "bin"} <= set(corpus.columns) else bin_columns(corpus)
    q = _renamed(queries)
    names = [*q.columns, *(x for x in corpus.columns if x not in ("level", "bin"))]
    dense, sparse = split_levels(corpus_levels(c) if levels is None else levels)
    out = []
    if sparse or not dense:
        top = F.broadcast(c.where(F.col("level").isin(sparse)))
        out.append(q.join(top, (q["q_chrom"] == top["chrom"]) & (top["start"] <= q["q_end"]) & (top["end"] >= q["q_start"]) & (q["q_start"] <= q["q_end"]) & (top["start"] <= top["end"])).select(*names))
    if dense:
        out.append(_met_in_bins(q, c.where(F.col("level").isin(dense)) if sparse else c, wide, dense, names))
    return reduce(DataFrame.union, out)


def _met_in_bins(q: DataFrame, c: DataFrame, wide: bool | None, levels: list[int], names: list[str]) -> DataFrame:
    """Pairs with the intervals of ``levels`` by an equi-join on bins."""
    if wide is None:
        wide = not q.where(F.col("q_end") - F.col("q_start") > WIDE).isEmpty()
    long = F.col("q_end") - F.col("q_start") > WIDE
    probe = q.withColumn("q_to", F.when(long, F.col("q_start")).otherwise(F.col("q_end"))) if wide else q.withColumn("q_to", F.col("q_end"))
    probe = probe.withColumn("q_at", F.explode(_query_bins("q_start", "q_to", levels)))
    meets = (probe["q_chrom"] == c["chrom"]) & (probe["q_at.level"] == c["level"]) & (probe["q_at.bin"] == c["bin"])
    both = _dealt(probe, len(levels)).join(c, meets & (c["start"] <= probe["q_to"]) & (c["end"] >= probe["q_start"])).select(*names)
    if not wide:
        return both
    inside = q.where(long).withColumn("q_at", F.explode(F.expr(f"sequence(shiftright(q_start, {WIDE_BITS}), shiftright(q_end, {WIDE_BITS}))")))
    meets = (inside["q_chrom"] == c["chrom"]) & (inside["q_at"] == F.shiftright(c["start"], WIDE_BITS))
    return both.union(_dealt(inside, len(levels)).join(c, meets & (c["start"] > inside["q_start"]) & (c["start"] <= inside["q_end"]) & (c["start"] <= c["end"])).select(*names))


def overlap_naive(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    q, c = _renamed(queries), corpus.drop("level", "bin")
    return q.join(c, (q["q_chrom"] == c["chrom"]) & (c["start"] <= q["q_end"]) & (c["end"] >= q["q_start"]))


def region_filter(region: Region) -> Column:
    """Pushed to the scan: partitions by chromosome, row groups by start and end."""
    if region.start > region.end:
        return F.lit(False)
    return (F.col("chrom") == region.chrom) & (F.col("start") <= region.end) & (F.col("end") >= region.start)


def overlap_literal(regions: list[Region], corpus: DataFrame) -> DataFrame:
    """Pairs for a few regions: one scan under the OR of their filters, each row repeated for every region it meets."""
    c = corpus.drop("level", "bin")
    if not regions:
        return c.where("false").select(F.lit("").alias("q_chrom"), F.lit(0).cast("long").alias("q_start"), F.lit(0).cast("long").alias("q_end"), "*")
    rows = c.where(reduce(lambda a, b: a | b, map(region_filter, regions)))
    struct = lambda r: F.struct(F.lit(r.chrom).alias("chrom"), F.lit(r.start).cast("long").alias("start"), F.lit(r.end).cast("long").alias("end"))
    met = F.filter(F.array(*map(struct, regions)), lambda r: (r["chrom"] == F.col("chrom")) & (F.col("start") <= r["end"]) & (F.col("end") >= r["start"]) & (r["start"] <= r["end"]))
    return rows.withColumn("q", F.explode(met)).select(F.col("q.chrom").alias("q_chrom"), F.col("q.start").alias("q_start"), F.col("q.end").alias("q_end"), *c.columns)


def overlap(queries: DataFrame | list[Region], corpus: DataFrame, strategy: str | None = None, levels: dict[int, int] | None = None) -> DataFrame:
    """Pairs by the named strategy; without one, ``literal`` for up to MOST_LITERALS regions and ``binned`` for the rest."""
    if isinstance(queries, list):
        if strategy in (None, "literal") and len(queries) <= MOST_LITERALS:
            return overlap_literal(queries, corpus)
        spark = corpus.sparkSession
        queries = spark.createDataFrame([(r.chrom, r.start, r.end) for r in queries], "chrom string, start bigint, end bigint")
    return overlap_naive(queries, corpus) if strategy == "naive" else overlap_binned(queries, corpus, levels=levels)


def count_rank(queries: DataFrame, corpus: DataFrame, by: list[str], bits: int = RANGE_BITS) -> DataFrame:
    """(``by``..., overlaps): hits of all queries on each group's intervals, without making a pair.

    An interval is met by the queries that start by its end, less those that end before its start: two running counts over the
    query ends in order of position. Positions are cut into ranges; counts before a range come from sums by range, so a
    chromosome is swept by as many tasks as it has ranges. Queries are counted by position first. Intervals and queries that end
    before they start meet nothing. Groups without a hit have no row.
    """
    q = queries.where("start <= end")
    ends = q.select("chrom", F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(0).alias("kind")), F.struct(F.col("end").alias("pos"), F.lit(2).alias("kind")))).alias("x"))
    ends = ends.groupBy("chrom", "x.pos", "x.kind").agg(F.count("*").alias("n"))
    ends = ends.select("chrom", "pos", "kind", F.when(F.col("kind") == 0, F.col("n")).otherwise(0).alias("s"), F.when(F.col("kind") == 2, F.col("n")).otherwise(0).alias("e"), F.lit(None).cast("int").alias("sign"), F.lit(0).cast("long").alias("times"), *(F.lit(None).cast(corpus.schema[b].dataType).alias(b) for b in by))
    point = lambda pos, sign: F.struct(pos.alias("pos"), F.lit(sign).alias("sign"))
    asks = corpus.where("start <= end").select("chrom", *by, F.explode(F.array(point(F.col("end"), 1), point(F.col("start"), -1))).alias("x"))
    asks = asks.groupBy("chrom", *by, "x.pos", "x.sign").agg(F.count("*").alias("times"))
    zero = F.lit(0).cast("long")
    asks = asks.select("chrom", "pos", F.lit(1).alias("kind"), zero.alias("s"), zero.alias("e"), "sign", "times", *by)
    rows = ends.unionByName(asks).withColumn("part", F.shiftright("pos", bits))
    before = Window.partitionBy("chrom").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = ends.groupBy("chrom", F.shiftright("pos", bits).alias("part")).agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    asked = asks.select("chrom", F.shiftright("pos", bits).alias("part")).distinct().select("chrom", "part", zero.alias("s"), zero.alias("e"))
    parts = parts.union(asked).groupBy("chrom", "part").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    parts = parts.select("chrom", "part", (F.sum("s").over(before) - F.col("s")).alias("s0"), (F.sum("e").over(before) - F.col("e")).alias("e0"))
    within = Window.partitionBy("chrom", "part").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"cs": F.sum("s").over(within), "ce": F.sum("e").over(within)}).where("kind = 1")
    rows = rows.join(F.broadcast(parts), ["chrom", "part"])  # no more rows than the genome's length over 2**bits
    hits = F.when(F.col("sign") == 1, F.col("cs") + F.col("s0")).otherwise(-(F.col("ce") + F.col("e0")))
    return rows.groupBy(*by).agg(F.sum(hits * F.col("times")).alias("overlaps")).where("overlaps > 0")


def count_pairs(pairs: DataFrame, by: list[str]) -> DataFrame:
    return pairs.groupBy(*by).agg(F.count("*").alias("overlaps"))
