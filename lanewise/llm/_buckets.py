"""Shuffling numpy records as one binary per batch and bucket, which costs little a record."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SCHEMA = "bucket bigint, part binary"


def packed(bucket: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket that has records."""
    # small numbers are sorted by radix
    few = len(bucket) and int(bucket.max()) < 1 << 16
    order = np.argsort(bucket.astype(np.uint16) if few else bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    edge = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] - 1)) if len(bucket) else np.zeros(0, np.int64)
    ends = [*edge[1:].tolist(), len(bucket)]
    parts = [records[a:b].tobytes() for a, b in zip(edge.tolist(), ends)]
    return pa.record_batch([pa.array(bucket[edge].astype(np.int64)), pa.array(parts, pa.binary())], names=["bucket", "part"])


def unpacked(column: pa.ChunkedArray | pa.Array, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)


def groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys starts and ends."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return start, np.append(start[1:], len(sorted_keys))


def spans_of(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each length, one after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start - (ends - length), length)


def chunks(counts: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose counts sum to about limit at most."""
    if not len(counts):
        return
    ends, first = np.cumsum(counts), 0
    while first < len(counts):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield first, last
        first = last


_CODEC = "zstd"


def deal_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with a group g as one compressed binary per batch and group (g, part); texts shrink more
    together than Spark's shuffle compression makes them."""
    for batch in batches:
        group = batch.column(batch.schema.get_field_index("g")).to_numpy()
        order = np.argsort(group, kind="stable")
        group = group[order]
        start, end = groups(group)
        parts = []
        for a, b in zip(start.tolist(), end.tolist()):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch.take(pa.array(order[a:b])))
            raw = sink.getvalue()
            parts.append(raw.size.to_bytes(8, "little") + pa.compress(raw, codec=_CODEC, asbytes=True))
        yield pa.record_batch([pa.array(group[start].astype(np.int64)), pa.array(parts, pa.binary())], names=["g", "part"])
        pa.default_memory_pool().release_unused()


def dealt_rows(parts: pa.ChunkedArray) -> pa.Table | None:
    """The rows of binaries made by deal_rows; None of none."""
    found = []
    for part in parts.to_pylist():
        raw = pa.decompress(part[8:], decompressed_size=int.from_bytes(part[:8], "little"), codec=_CODEC)
        found.append(pa.ipc.open_stream(raw).read_all())
    return pa.concat_tables(found) if found else None
