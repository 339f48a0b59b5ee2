"""Connected components by alternating star contractions, every step a pre-aggregated join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervale.llm.common import staged

#: Edges up to which one task joins them in memory, 16 bytes each; above it they are contracted by joins.
IN_TASK = 1_000_000


def _in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) by union-find over all edges of one partition."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = top(u), top(v)
            up[max(x, y)] = min(x, y)
    nodes = np.array(list(up), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.array([top(int(x)) for x in nodes], np.int64))], ["node", "root"])


def components(edges: DataFrame, label: str = "components", in_task: int = IN_TASK) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node of its component.

    Few edges, by a count, are joined in one task. Else large-star then small-star (Kiveris et al., 2014) until nothing changes: neighbours are only ever reduced to their
    minimum, map-side first, so a hub costs a row a task. Each round is staged; only a count and a checksum reach the
    driver. No edges give an empty result.
    """
    cur = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if edges.limit(in_task + 1).count() <= in_task:
        return staged(cur.coalesce(1).mapInArrow(_in_task, "node bigint, root bigint"), label)
    cur = staged(cur.distinct(), label)
    mark = None
    while True:
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
        if not now[0]:
            break
        both = cur.union(cur.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("n")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, label)
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        small = large.join(low, F.col("u") == F.col("n"))
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("n", "m")).distinct()
        cur = staged(small, label)
    nodes = cur.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return staged(nodes.union(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), label)
