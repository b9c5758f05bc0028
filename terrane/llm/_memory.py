"""Giving memory back between tasks: workers are kept by Spark, and with them whatever a task has left behind."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import SparkSession

Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def release() -> None:
    """Frees what nothing refers to and returns the allocators' free pages to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: its allocator keeps its pages
        return


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Sets the session to send workers that many rows at a time at most: texts come in megabytes, not tens of them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def lean(kernel: Kernel) -> Kernel:
    """The kernel for mapInArrow, with ``release`` after its last batch."""

    @wraps(kernel)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            release()

    return run
