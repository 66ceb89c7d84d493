"""Vectorised word work on Arrow batches of texts, for functions passed to ``mapInArrow``.

A batch is cut into chunks of bounded size (whole documents; one larger document is a chunk of
its own), the chunk's UTF-8 bytes are one array, and words, lines and hashes are found by
array operations over those bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
UPPER = np.arange(256, dtype=np.uint8)
UPPER[0x41:0x5B] += 0x20  # A-Z to a-z
ALNUM = np.zeros(256, bool)  # digits, a-z and every byte of a non-ASCII character
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


class Powers:
    """Powers of the hash base and of its inverse, as long as the longest chunk so far."""

    up = np.ones(1, _U)
    down = np.ones(1, _U)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                a = np.full(size, base, _U)
                a[0] = 1
                np.multiply.accumulate(a, out=a)
                setattr(cls, name, a)
        return cls.up[:n], cls.down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums of byte * base^position, one longer than ``data``."""
    up, _ = Powers.of(len(data) + 1)
    out = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[:-1], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from ``start`` to ``end``, the same wherever they stand."""
    _, down = Powers.of(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U))


def chunks(batch: pa.RecordBatch, name: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple]:
    """(first row, last row + 1, bytes, offsets of the rows and the end) of consecutive rows;
    a null text has no bytes."""
    text = batch.column(batch.schema.get_field_index(name))
    if text.type != pa.large_string():
        text = text.cast(pa.large_string())
    n = len(text)
    offsets = np.frombuffer(text.buffers()[1], np.int64, n + 1, text.offset * 8) if n else np.zeros(1, np.int64)
    if text.null_count:
        lengths = np.where(text.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    else:
        lengths = np.diff(offsets)
    raw = np.frombuffer(text.buffers()[2], np.uint8) if n and text.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    ends = np.cumsum(lengths)
    while row < n:
        done = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, done + limit, "right")))
        at = np.concatenate([[0], ends[row:stop] - done])
        if text.null_count:
            parts = [raw[offsets[i]:offsets[i] + lengths[i]] for i in range(row, stop)]
            data = np.concatenate(parts) if parts else raw[:0]
        else:
            data = raw[offsets[row]:offsets[stop]]
        yield row, stop, data, at
        row = stop


def spans(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes, never across the document offsets ``at``."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, at: np.ndarray, alnum: bool = False, lower: bool = True) -> tuple:
    """(bytes, starts, ends, document of each word, word offsets of the documents)."""
    if lower:
        data = UPPER[data]
    start, end = spans(ALNUM[data] if alnum else ~WHITE[data], at)
    first = np.searchsorted(start, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return data, start, end, doc, first


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of every run, concatenated."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    full = lengths > 0
    s, n = starts[full].astype(np.int64), lengths[full].astype(np.int64)
    heads = np.concatenate([[0], np.cumsum(n)[:-1]])
    out[heads] = s
    out[heads[1:]] -= s[:-1] + n[:-1] - 1
    return np.cumsum(out)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
