"""Numpy kernels over the bytes of a batch of texts: words, rolling hashes, hash mixing.

A word is a run of bytes other than 0x20 and 0x09-0x0D, so on UTF-8 it is ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Bytes that one kernel call works on; a single longer text is a call of its own.
SLICE_BYTES = 3 << 20
_WORD_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None  # glibc's
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n-1 and the inverses, modulo 2**64; kept for the next call."""
    up, down = _tables.get(base, (np.ones(1, U64), np.ones(1, U64)))
    if len(up) < n:
        size = 1 << max(12, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            full = [np.full(size, b, U64) for b in (base, pow(base, -1, 1 << 64))]
            for f in full:
                f[0] = 1
            up, down = (np.multiply.accumulate(f) for f in full)
        if size <= SLICE_BYTES * 2:
            _tables[base] = up, down
    return up[:n], down[:n]


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: the worker goes on to other work, beside others."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row past the last, bytes, offsets) of slices of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + SLICE_BYTES, "right")) - 1)
        yield at, to, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word; first[d]: the first word of text d, with one entry past the last."""
    inside = ~_SPACE[data]
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offs), np.int64)
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    before[offs[:-1][offs[:-1] < len(data)]] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[offs[1:][offs[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of each word of ``data``, in order: the xxh3 hash of its bytes, taken once for each distinct word."""
    if not len(starts):
        return np.zeros(0, U64)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    body = data[~_SPACE[data]]  # the words and nothing else
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)]).dictionary_encode()
    forms = coded.dictionary
    values = np.fromiter(map(xxhash.xxh3_64_intdigest, forms.to_pylist()), U64, len(forms))
    return values[coded.indices.to_numpy()]


def rolling(hashes: np.ndarray, k: int, base: int = _WORD_BASE) -> np.ndarray:
    """Rabin-Karp value of every k consecutive words (of whatever text), mixed; n - k + 1 values, or none."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        up, down = powers(base, n)
        sums = np.zeros(n + 1, U64)
        np.cumsum(hashes * up, out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


def window_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of each window of k words that lies in one text."""
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    text = np.repeat(np.arange(len(counts)), counts)
    return text, np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + first[:-1][text]
