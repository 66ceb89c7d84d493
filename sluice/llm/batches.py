"""Arrow batches of bounded size for operators whose rows are texts or sets."""

from __future__ import annotations

import ctypes
import functools
import sys
from collections.abc import Callable

import pyarrow as pa

BATCH_BYTES = 8 << 20
_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(operator: Callable) -> Callable:
    """Run an operator (its first argument is the session) with Arrow batches of at most ``BATCH_BYTES``
    for the tables it stores; the session's own setting is back when it returns. A batch is held
    several times over, by the JVM, on the way and in Python, in every task of an executor."""
    @functools.wraps(operator)
    def run(spark, *args, **kwargs):
        before = spark.conf.get(_CONF, None)
        spark.conf.set(_CONF, str(BATCH_BYTES))
        try:
            return operator(spark, *args, **kwargs)
        finally:
            spark.conf.unset(_CONF) if before is None else spark.conf.set(_CONF, before)
    return run


def give_back(run: Callable) -> Callable:
    """A function for ``mapInArrow`` whose worker returns the memory it no longer uses to the system
    when its task ends: workers stay for later stages, which need it elsewhere in the executor."""
    @functools.wraps(run)
    def released(batches):
        try:
            yield from run(batches)
        finally:
            trim()
    return released


def trim() -> None:
    """Return the memory that this process no longer uses to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
