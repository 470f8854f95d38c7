"""Memory of Python workers: small Arrow batches, and giving back what a finished task held.

A worker stays with its executor between stages, so what its allocators keep adds to the memory of stages that run no Python at all.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS = 1000


def give_back() -> None:
    """Return freed memory of Python, Arrow and the C library to the system, where that is possible."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function of batches, which gives memory back when its task ends."""
    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()
    return tidied


@contextmanager
def small_batches(spark: SparkSession, rows: int = ROWS):
    """Arrow batches of at most ``rows`` rows for jobs that run inside, whatever the session's setting."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)
