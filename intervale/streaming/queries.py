"""A stream of query intervals against a static corpus: a stateless stream-static equi-join on bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from intervale.functions.scalars import normalize_chrom
from intervale.operators.overlap import LEVELS, overlap_binned


def stream_overlap(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Pairs of each micro-batch; wide queries and all levels are allowed for, since a stream can't be looked at beforehand and the
    corpus may have grown when a batch runs."""
    q = queries.withColumn("chrom", normalize_chrom(F.col("chrom")))
    return overlap_binned(q, corpus, wide=True, levels=dict.fromkeys(LEVELS, 1 << 62))


def stream_counts(queries: DataFrame, corpus: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Hits per file of each micro-batch, written under its number; a batch that is replayed overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        n = batch.groupBy("file_id").agg(F.count("*").alias("overlaps"))
        n.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream_overlap(queries, corpus).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
