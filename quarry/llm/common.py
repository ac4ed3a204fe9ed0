"""What the training-data operators share: the shared folder, tables cut from
their lineage, and safe column names."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.sources.scratch import dropped, folder, release, saved, scratch  # noqa: F401

#: The white space of every word rule: space and U+0009 to U+000D.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

shared_dir, written, discard = folder, saved, dropped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, whatever the letters' case."""
    have = {c.lower() for c in df.columns}
    while base.lower() in have:
        base += "_"
    return base


def bounded_batches(spark: SparkSession, most: str = "4m") -> None:
    """Let Spark send Python workers batches of some megabytes. It counts rows
    only unless told otherwise, and 10,000 long texts at once are held by the
    JVM, outside of its heap, and by the worker. A session's own setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, most)


def byte_slices(batch: pa.RecordBatch, column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` bytes of a column's text: what a
    worker makes of a slice doesn't grow with the rows that Spark sends at once.
    A single longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        past = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, past - at)
        at = past


def give_back() -> None:
    """Return a Python worker's free memory to the machine. Spark keeps workers
    of ended tasks for a minute, as many as ever ran at once; what each holds counts
    towards its executor. To be called when a task is through with its batches."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else as it is. lower() is the fast way for a text
    of ASCII only; translate() leaves the letters beyond it alone."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def id_crc32(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; the folds of the classifiers rest on it."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


def buckets_for(rows: int, per_bucket: int = 100_000) -> int:
    """How many hash buckets keep each near ``per_bucket`` rows (64 to 65,536)."""
    return max(64, min(65_536, -(-rows // per_bucket)))


def ranked(df: DataFrame, key: str, order: list[str], out: str, rows: int) -> DataFrame:
    """``df`` with ``out``: a gapless rank from 0 within ``key``.

    No window holds a whole key: rows are numbered within the hash bucket of
    their first order column, and each bucket starts where the counts of the
    buckets before it end.
    """
    b = f"{out}_bucket"
    n = buckets_for(rows)
    dealt = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    counts = dealt.groupBy(key, b).agg(F.count("*").alias(f"{out}_n"))
    before = F.coalesce(F.sum(f"{out}_n").over(Window.partitionBy(key).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(key, b, before.alias(f"{out}_start"))
    own = F.row_number().over(Window.partitionBy(key, b).orderBy(*order)) - 1
    return dealt.withColumn(f"{out}_own", own).join(starts, [key, b]).withColumn(out, F.col(f"{out}_start") + F.col(f"{out}_own")).drop(b, f"{out}_own", f"{out}_start")
