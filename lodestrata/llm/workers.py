"""What a Python worker keeps between tasks: one model or word table at a time."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession

_held: dict[Any, Any] = {}

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def trim() -> None:
    """Give back the memory that is free, where Arrow and the C library can: a
    worker that waits for its next task still counts in its executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: the memory is reused by this process


def release() -> None:
    """Let go of what is kept, and give the memory back."""
    if not _held:
        return
    _held.clear()
    gc.collect()
    trim()


@contextmanager
def batches_of(spark: SparkSession, size: str) -> Iterator[None]:
    """What runs inside reaches workers in batches of about so many bytes at
    most, or one row; they are built outside the heap, twice while they grow."""
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, before)


def resident(key: Any, make: Callable[[], Any]) -> Any:
    """The object of ``key``, made where another one is kept."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]
