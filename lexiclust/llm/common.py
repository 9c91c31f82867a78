"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiclust.session import ship_package, stored  # noqa: F401  (stored: for the operators)
from lexiclust.sources.tables import read_table

HELD_OUT_FOLDS = 5  # rows whose crc32(doc_id) mod 5 is 0 are held out
CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 512
BATCH_ROWS = 1000  # texts, or what is made of them, in one Arrow batch
BATCH_BYTES = 8 << 20  # a longer row, such as a list with its sets, stands alone


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, with this package shipped to the Python workers."""
    ship_package(spark)
    return read_table(spark, sf_dir, name)


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5 = 0; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % HELD_OUT_FOLDS == 0, F.lit(False))


def chunks(texts: pa.Array, max_bytes: int = CHUNK_BYTES,
           max_rows: int = CHUNK_ROWS) -> Iterator[list[str | None]]:
    """The rows of a string array in order, as lists of at most ``max_rows``
    texts and about ``max_bytes`` bytes (a longer text stands alone)."""
    n = len(texts)
    sizes = np.zeros(n, dtype=np.int64)
    for i, v in enumerate(pc.binary_length(texts).to_pylist()):
        sizes[i] = v or 0
    at = 0
    while at < n:
        end, total = at, 0
        while end < n and end - at < max_rows and (end == at or total + sizes[end] <= max_bytes):
            total += int(sizes[end])
            end += 1
        yield texts.slice(at, end - at).to_pylist()
        at = end


def bounded_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df`` by hash order of ``key``: all of them when
    there are fewer, else the share ``rows / count`` of the hash range. The
    same rows whatever the partitioning; rows of a null key are left out."""
    kept = df.where(key.isNotNull())
    total = kept.count()
    if total <= rows:
        return kept
    share = int(rows / total * (1 << 31))
    return kept.where(F.pmod(F.xxhash64(key), F.lit(1 << 31)) < share)


def bounded_batches(spark: SparkSession) -> None:
    """At most ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` an Arrow batch in this
    session. Texts are some KB each and their shingle sets twice that, so Spark's
    10,000 rows would be some 100 MB in a worker and as much in the JVM's buffers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return what this worker has freed to the system (Arrow's pool and the C heap): a
    worker that waits for its next task should not keep the last one's buffers."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


class Shared:
    """A broadcast value and what each worker process builds from it, once."""

    _built: dict = {}

    def __init__(self, spark: SparkSession, value):
        bounded_batches(spark)
        self.key = uuid.uuid4().hex
        self.sent = spark.sparkContext.broadcast(value)

    def build(self, make):
        """``make(value)``, kept for later tasks of the worker. A worker holds
        one of them at a time: what an earlier job built goes first."""
        if self.key not in Shared._built:
            Shared._built.clear()
            Shared._built[self.key] = make(self.sent.value)
        return Shared._built[self.key]

    def once(self):
        """The value, for this use alone: a worker that takes several in turn loads each
        from its file and keeps none."""
        value = self.sent.value
        if getattr(self.sent, "_path", None):
            self.sent.__dict__.pop("_value", None)
        return value

    @staticmethod
    def release() -> None:
        """Free what earlier jobs built in this worker, for a job that needs none of it."""
        if Shared._built:
            Shared._built.clear()
            give_back()
