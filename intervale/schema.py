"""Column layouts of interval tables."""

from __future__ import annotations

from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

#: Coordinates are BIGINT, closed at both ends, as the files have them.
INTERVAL = StructType([StructField("chrom", StringType()), StructField("start", LongType()), StructField("end", LongType())])
FILES = StructType([StructField("file_id", LongType()), StructField("file_name", StringType()), StructField("num_intervals", LongType()), StructField("mean_interval_size", DoubleType())])
#: The length of the human genome that enrichment takes if none is given.
GENOME_SIZE = 3095677412
