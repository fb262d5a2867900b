"""Vectorised tokenisation of whole Arrow string columns with numpy.

A batch of texts is looked at as one byte buffer.  Word and n-gram hashes come
from a prefix polynomial over that buffer (arithmetic modulo 2**64), so no
Python code runs per word.  Batches are cut by bytes, never inside a document:
memory per task stays near ``SLICE_BYTES`` times a small factor, or the longest
single document.

Nulls are read as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2_000_000
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def _power(n: int, inverse: bool) -> np.ndarray:
    name = "inverse" if inverse else "forward"
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, _P_INV if inverse else _P, np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts together, and the n + 1 offsets of the texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def release() -> None:
    """Gives freed memory back to the system; without a C library that can, it stays with the process."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The work of a task, after which nothing of it stays: Python workers are used again by other stages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def slices(batch: pa.RecordBatch, columns: int | tuple[int, ...], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of whole rows of about ``most`` bytes of text in the columns."""
    sizes = np.zeros(len(batch), np.int64)
    for c in (columns,) if isinstance(columns, int) else columns:
        sizes += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def _table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


#: Bytes of [\x20\x09-\x0D].
SPACES = _table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: All but letters and digits; bytes of non-ASCII characters count as letters.
NOT_ALNUM = ~(_table(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") | (np.arange(256) >= 128))
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return _ASCII_LOWER[data]


@dataclass
class Words:
    start: np.ndarray  # first byte
    end: np.ndarray  # one past the last byte
    hash: np.ndarray  # uint64
    doc: np.ndarray  # row in the batch
    first: np.ndarray  # n + 1 offsets: the words of document i are first[i]:first[i + 1]


class Prefix:
    """Prefix hashes of a byte buffer."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data] * _power(len(data), False), out=self.sums[1:])
        self.back = _power(len(data) + 1, True)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end], the same wherever the bytes stand."""
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def grams(self, n: int) -> np.ndarray:
        """Hashes of all runs of n bytes."""
        size = len(self.sums) - n
        return mix((self.sums[n:] - self.sums[:-n]) * self.back[:size] + np.uint64(n)) if size > 0 else np.zeros(0, np.uint64)


def words(data: np.ndarray, at: np.ndarray, separators: np.ndarray = SPACES, prefix: Prefix | None = None) -> Words:
    """Maximal runs of bytes that are no separators, within each document."""
    gap = separators[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = True
    before[1:] = gap
    before[at[:-1]] = True
    after = np.empty(len(data) + 1, bool)
    after[:-1] = gap
    after[at[1:]] = True
    start = np.flatnonzero(~gap & before[:-1])
    end = np.flatnonzero(~gap & after[1:]) + 1
    first = np.searchsorted(start, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return Words(start, end, (prefix or Prefix(data)).spans(start, end), doc, first)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]]."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
