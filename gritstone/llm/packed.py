"""Packed exchanges: many small entries travel as a few rows of binary columns.

A producer sorts its entries by bucket and sends one row per bucket and slice of text; each column of the row holds
one array's bytes. A consumer reads the rows of its buckets in order and gives back each bucket's arrays. Buckets are
hashes and their number follows the input's size, so a bucket is bounded and no key decides where much data goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def blocks(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row for each bucket that has entries; two-dimensional columns keep their width."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    begins = np.concatenate([[0], cuts]).astype(np.int64) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(begins[1:], len(bucket)) if len(bucket) else begins
    arrays = [pa.array(bucket[begins].astype(np.int32), pa.int32())]
    for values in columns.values():
        raw = np.ascontiguousarray(values[order])
        width = raw.itemsize * (raw.shape[1] if raw.ndim > 1 else 1)
        offsets = (np.append(begins, ends[-1:]) * width).astype(np.int32) if len(begins) else np.zeros(1, np.int32)
        arrays.append(pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())]))
    return pa.RecordBatch.from_arrays(arrays, ["bucket", *columns])


def ragged(bucket: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> pa.Array:
    """A column beside those of ``blocks`` whose entries have ``lengths`` rows of ``flat`` each."""
    order = np.argsort(bucket, kind="stable")
    m, begin = lengths[order], (np.cumsum(lengths) - lengths)[order]
    take = np.repeat(begin, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    raw = np.ascontiguousarray(flat[take])
    width = raw.itemsize * (raw.shape[1] if raw.ndim > 1 else 1)
    sorted_bucket = bucket[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(sorted_bucket)) + 1, [len(order)]]) if len(order) else np.zeros(1, np.int64)
    offsets = np.concatenate([[0], np.cumsum(m)])[cuts] * width
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])


def by_bucket(batches: Iterator[pa.RecordBatch], columns: dict[str, np.dtype]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Each bucket's arrays, from rows that come ordered by bucket."""
    now, held = None, {c: [] for c in columns}

    def joined() -> dict[str, np.ndarray]:
        return {c: np.frombuffer(b"".join(held[c]), t) for c, t in columns.items()}

    for batch in batches:
        keys = batch.column("bucket").to_pylist()
        cells = {c: batch.column(c) for c in columns}
        for i, key in enumerate(keys):
            if key != now:
                if now is not None:
                    yield now, joined()
                now, held = key, {c: [] for c in columns}
            for c in columns:
                value = cells[c][i]
                if value.is_valid:
                    held[c].append(value.as_buffer())
    if now is not None:
        yield now, joined()


def schema_of(columns: dict, extra: str = "") -> str:
    return "bucket int, " + ", ".join(f"{c} binary" for c in columns) + extra
