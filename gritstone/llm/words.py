"""Vectorised words and hashes over Arrow text columns.

Words are ``[^\\x20\\x09-\\x0D]+``: maximal runs of bytes other than ASCII white space, whatever the script. All
hashes are polynomial, modulo 2**64, over prefix sums, and then mixed; equal words or word sequences get equal hashes
in every process and on every machine.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MASK = (1 << 64) - 1
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95
#: Bytes of text handled at once; a longer document makes a slice of its own.
SLICE_BYTES = 1 << 19

_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_plain = _lower.copy()
_plain[[i for i in range(33, 127) if not chr(i).isalnum()]] = 32
_powers: dict[int, np.ndarray] = {}


def trimmed(run: Callable) -> Callable:
    """A partition function that gives freed memory back to the system when it ends, as idle workers keep theirs."""

    @wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return inner


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_byte_value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BYTE_BASE))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1, -(-n // (1 << 16))) << 16
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size > 1 << 20:  # kept only for common sizes
            return have[:n]
        _powers[base] = have
    return have[:n]


def run_hash(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mixed hash of values[start:end] for each pair."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n), out=sums[1:])
    back = powers(pow(base, -1, 1 << 64), n + 1)
    return mix((sums[ends] - sums[starts]) * back[starts])


@dataclass
class Words:
    """The words of some documents: word i of document d is at first[d] + i; its bytes are data[starts:ends] there."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    raw: np.ndarray  # the bytes before punctuation and case were changed, at the same places

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(texts: pa.Array, lower: bool = False, plain: bool = False) -> Words:
    """Words and word hashes of a string array; null is an empty text.

    ``lower`` lower-cases A-Z; ``plain`` lower-cases all letters and takes ASCII punctuation for white space.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if plain:
        texts = pc.utf8_lower(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    given = data
    if lower or plain:
        data = (_plain if plain else _lower)[data]
    n = len(data)
    solid = ~_space[data]
    edge = np.zeros(n + 1, bool)  # a document begins here, so no word goes across
    edge[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:n]
    finishes = solid.copy()
    finishes[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets), run_hash(_byte_value[data], BYTE_BASE, starts, ends), given)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes of text, so that memory follows the slice, not the batch."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    piece = (np.cumsum(sizes) - sizes) // most
    cuts = np.flatnonzero(np.diff(piece)) + 1
    bounds = [0, *cuts.tolist(), batch.num_rows]
    for a, b in zip(bounds, bounds[1:]):
        yield batch.slice(a, b - a)


def gram_hash(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k words in a row, and whether position i starts such a run inside its document."""
    n = len(words.hashes)
    inside = np.zeros(n, bool)
    if n < k:
        return np.zeros(n, np.uint64), inside
    at = np.arange(n - k + 1)
    out = np.zeros(n, np.uint64)
    out[: n - k + 1] = run_hash(words.hashes, WORD_BASE, at, at + k)
    last = np.repeat(words.first[1:], words.counts())
    inside[:] = np.arange(n) + k <= last
    return out, inside
