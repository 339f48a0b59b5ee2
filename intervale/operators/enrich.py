"""Catalog statistics and the enrichment of each file: 2x2 table, odds ratio, Fisher's exact test, combined score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervale.functions.fisher import fisher_tails
from intervale.functions.scalars import log2fc, neg_log10, safe_subtract
from intervale.schema import GENOME_SIZE


def file_statistics(intervals: DataFrame, by: str = "file_name") -> DataFrame:
    """``by``, num_intervals, mean_interval_size."""
    return intervals.groupBy(by).agg(F.count("*").alias("num_intervals"), F.avg(F.col("end") - F.col("start")).alias("mean_interval_size"))


def with_zeros(files: DataFrame, counts: DataFrame, by: str = "file_name") -> DataFrame:
    """Every file with its ``overlaps``, 0 where it has none."""
    return files.join(counts.select(F.col(by).alias("_f"), "overlaps"), F.col(by) == F.col("_f"), "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(0)).cast("long")).drop("_f")


def contingency(files: DataFrame, queries: DataFrame, genome_size: float = GENOME_SIZE) -> DataFrame:
    """``files`` (num_intervals, mean_interval_size, overlaps) with n11, n12, n21, n22.

    n22 comes from how many intervals of the joint mean size the genome holds. The query set counts all its rows. A file
    without intervals has no mean, and its table no room beyond what is counted.
    """
    q = queries.agg(F.count("*").alias("q_n"), F.avg(F.col("end") - F.col("start")).alias("q_mean"))
    t = files.join(F.broadcast(q))  # one row
    t = t.withColumn("n11", F.col("overlaps"))
    t = t.withColumn("n12", safe_subtract(F.col("q_n"), F.col("n11"))).withColumn("n21", safe_subtract(F.col("num_intervals"), F.col("n11")))
    known = F.col("n11") + F.col("n12") + F.col("n21")
    room = F.try_divide(F.lit(float(int(genome_size))), F.col("mean_interval_size") + F.col("q_mean"))
    full = F.greatest(known.cast("double"), F.coalesce(room, F.lit(0.0))).cast("bigint")
    return t.withColumn("n22", safe_subtract(full, known)).drop("q_n", "q_mean")


def odds_ratio(table: DataFrame) -> DataFrame:
    """With one added to all cells but n12, which counts as at least 1."""
    odds = ((F.col("n11") + 1) / F.greatest(F.lit(1), F.col("n12"))) / ((F.col("n21") + 1) / (F.col("n22") + 1))
    return table.withColumn("odds_ratio", odds)


def significance(table: DataFrame) -> DataFrame:
    """With odds_ratio, fishers_two_tail, fishers_left_tail, fishers_right_tail, combo_score."""
    t = odds_ratio(table).withColumn("tails", fisher_tails(*map(F.col, ("n11", "n12", "n21", "n22"))))
    t = t.select("*", F.col("tails.two").alias("fishers_two_tail"), F.col("tails.left").alias("fishers_left_tail"), F.col("tails.right").alias("fishers_right_tail")).drop("tails")
    return t.withColumn("combo_score", log2fc(F.col("odds_ratio")) * neg_log10(F.col("fishers_two_tail")))


#: Columns of the significance report, in order.
REPORT = ("file_name", "file_size", "overlaps", "odds_ratio", "fishers_two_tail", "fishers_left_tail", "fishers_right_tail", "combo_score")


def report(table: DataFrame) -> DataFrame:
    return significance(table).withColumn("file_size", F.col("num_intervals")).select(*REPORT)
