"""Giving memory back between batches: Python workers live on between tasks, and what their
allocators hold for later counts against the executor."""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Bytes of groups after which memory is released, and seconds between releases in a stream.
GROUP_BYTES, SECONDS = 4 << 20, 0.5


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library, which has no such call


def batches(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """f for mapInArrow, releasing memory now and then and at the end."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = time.monotonic()
        for out in f(stream):
            yield out
            del out
            if time.monotonic() - last > SECONDS:
                release()
                last = time.monotonic()
        release()

    return run


def group(f: Callable[[pa.Table], pa.Table]):
    """f for applyInArrow over groups; releases after each large one."""

    def run(table: pa.Table) -> pa.Table:
        size = table.nbytes
        out = f(table)
        del table
        if size > GROUP_BYTES:
            release()
        return out

    return run


def cogroup(f: Callable[[pa.Table, pa.Table], pa.Table]):
    """f for applyInArrow over groups of two tables; releases after each large one."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        size = left.nbytes + right.nbytes
        out = f(left, right)
        del left, right
        if size > GROUP_BYTES:
            release()
        return out

    return run
