"""Numpy helpers on the bytes of many texts at once: spans of words, hashes of spans and of windows of them."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES, CHUNK_ROWS = 1 << 20, 512
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE, SECOND_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd, so that they have inverses modulo 2^64


def give_back() -> None:
    """Free memory of this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def tidied(rows: Iterator) -> Iterator:
    """The same rows; behind the last one, what a task's arrays held is given back: workers outlive their tasks."""
    try:
        yield from rows
    finally:
        give_back()


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of every hash spread over all of it."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=8)
def byte_values(seed: int) -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))


_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, inverse: bool = False, base: int = BASE) -> np.ndarray:
    """base (or its inverse) to the powers 0 to n - 1, modulo 2^64."""
    have = _POWERS.get((base, inverse))
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, pow(base, -1, 1 << 64) if inverse else base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 4 * CHUNK_BYTES:
            _POWERS[base, inverse] = have
    return have[:n]


class Rolling:
    """Hashes of any spans of a sequence of 64-bit values, by prefix sums."""

    def __init__(self, values: np.ndarray, base: int = BASE):
        self.base = base
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * powers(len(values), base=base), out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * powers(len(self.sums), True, self.base)[starts])

    def windows(self, width: int) -> np.ndarray:
        """Hash of each window of width values, by its start."""
        n = max(len(self.sums) - width, 0)
        return mixed((self.sums[width : width + n] - self.sums[:n]) * powers(n, True, self.base))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column, and len + 1 offsets; nulls are empty."""
    n = len(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end row, bytes and offsets of groups of whole texts of about size bytes."""
    raw, at = buffers(column)
    a, n = 0, len(at) - 1
    while a < n:
        b = int(np.searchsorted(at, at[a] + size, side="right")) - 1
        b = min(max(b, a + 1), a + rows, n)
        yield a, b, raw[at[a] : at[b]], at[a : b + 1] - at[a]
        a = b


#: Bytes that no word holds.
SPACES = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
_WORD = np.ones(256, np.uint8)
_WORD[SPACES] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Letters, digits and all bytes of other scripts 1, the rest 2, white space 0.
_KINDS = _WORD * 2
_KINDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def lowered(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def spans(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the runs of one kind above 0; no run goes beyond its text."""
    n = len(kind)
    change = np.ones(n + 1, bool)
    change[1:n] = kind[1:] != kind[:-1]
    change[offsets] = True
    cut = np.flatnonzero(change)
    starts, ends = cut[:-1], cut[1:]
    keep = kind[starts] > 0
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def in_word(raw: np.ndarray) -> np.ndarray:
    """Which bytes stand in words."""
    return _WORD[raw].view(bool)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the words: runs without space, tab, line ends."""
    return spans(_WORD[raw], offsets)


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As words, with runs of signs apart from letters and digits."""
    return spans(_KINDS[raw], offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, base: int = BASE) -> np.ndarray:
    return Rolling(byte_values(seed)[raw], base).spans(starts, ends)
