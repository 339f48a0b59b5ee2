"""What the text operators share: words, folds of the labelled rows, staging, bounded joins."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.tables import shared_dir, staged, table

__all__ = ["SPACE", "WORD", "bounded_join", "fold", "free_name", "pieces_of", "shared_dir", "small_batches", "staged", "table", "trim", "word_array"]

#: ASCII white space and its complement, as every contract here splits words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a key table (16 bytes a row) is broadcast; above it the join shuffles.
BROADCAST_ROWS = 400_000


def word_array(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id's decimal digits, modulo k; null ids count as the empty string."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(k))


def bounded_join(left: DataFrame, keys: DataFrame, on, how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a staged key table: broadcast if a count proves it small, else shuffled with skew handling."""
    return left.join(F.broadcast(keys) if keys.limit(limit + 1).count() <= limit else keys, on, how)


def pieces_of(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows whose sizes add up to ``most`` at most; a larger row is a run of its own, whatever is beside it."""
    start, total = 0, 0
    for k, n in enumerate(sizes):
        if k > start and total + n > most:
            yield start, k
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def free_name(name: str, columns: list[str]) -> str:
    """``name``, or with as many underscores behind it as make it differ from all ``columns``."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """From now on the session sends Python at most ``rows`` rows at a time, or fewer where it already does: rows hold whole texts
    or sets, and what is sent at a time is held several times over, by the JVM and by the worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    spark.conf.set(name, str(min(rows, now) if now > 0 else rows))


def trim() -> None:
    """Give the memory that a worker has freed back to the system, where the C library can: workers live on, and what one
    stage's arrays took would count against the next."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
