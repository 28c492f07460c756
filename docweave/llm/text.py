"""Vectorised words, hashes and shingles over Arrow string batches.

Everything works on the UTF-8 bytes of a run of whole documents at a time.  A
run holds about ``RUN_BYTES`` bytes (a longer document makes a run of its own),
so memory follows the longest document and not the batch.

Words are ``[^\\x20\\x09-\\x0D]+``: all of these separators are single ASCII
bytes, so splitting bytes and splitting characters give the same words.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 19

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; returns a new array."""
    x = x ^ (x >> U64(30))
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


#: One random 64-bit value for each byte; the second folds A-Z to a-z.
BYTE = mix(np.arange(1, 257, dtype=U64) * _BASE)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
BYTE_LOWER = BYTE[_FOLD]
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True


class Powers:
    """Powers of an odd base modulo 2**64, and of its inverse; grows on demand."""

    def __init__(self, base: int = 0xD6E8FEB86659FD93) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def reach(self, n: int) -> Powers:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            self.up = np.cumprod(np.r_[U64(1), np.full(n - 1, self.base, U64)], dtype=U64)
            self.down = np.cumprod(np.r_[U64(1), np.full(n - 1, self.inverse, U64)], dtype=U64)
        return self


POWERS = Powers()


def prefix_hashes(data: np.ndarray, table: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    """Running polynomial sums; see ``span_hashes``."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(table[data] * powers.reach(len(data) + 1).up[: len(data)], out=out[1:], dtype=U64)
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    """Hash of the bytes in each [start, end), wherever they stand."""
    x = (sums[end] - sums[start]) * powers.down[start]
    return mix(x + (end - start).astype(U64) * _BASE)


#: Spans over so many bytes are hashed by a digest.  Powers modulo 2**64 lose bits on
#: long self-similar spans (Thue-Morse words of 1,024 bytes all collide); at 32 bytes no more than 19 of 64.
EXACT_OVER = 32


def sure_hashes(data: np.ndarray, sums: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """As ``span_hashes``, with a keyed digest for long spans: for equality of words and lines of any length."""
    out = span_hashes(sums, start, end)
    for i in np.flatnonzero(end - start > EXACT_OVER).tolist():
        raw = data[start[i] : end[i]]
        digest = hashlib.blake2b((_FOLD[raw] if lower else raw).tobytes(), digest_size=8, key=b"span").digest()
        out[i] = int.from_bytes(digest, "little")
    return out


@dataclass
class Run:
    """Some whole documents: rows first..last-1 of a batch, their bytes end to end."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray  # last - first + 1 of them, from 0

    def __len__(self) -> int:
        return self.last - self.first

    def bytes_of(self, i: int) -> np.ndarray:
        return self.data[self.offsets[i] : self.offsets[i + 1]]


def runs(column: pa.Array, limit: int = RUN_BYTES, rows: int = 20_000) -> Iterator[Run]:
    """Cuts a string (or binary) column into runs; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n, lo + rows)
        yield Run(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def word_spans(run: Run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (and the end)."""
    inside = ~SEPARATOR[run.data]
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[run.offsets] = True
    before = np.ones(n, bool)
    before[1:] = ~inside[:-1]
    before |= edge[:n]
    after = np.ones(n, bool)
    after[:-1] = ~inside[1:]
    after |= edge[1:]
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, run.offsets)


def word_hashes(run: Run, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and each document's range of words."""
    starts, ends, bounds = word_spans(run)
    sums = prefix_hashes(run.data, BYTE_LOWER if lower else BYTE)
    return sure_hashes(run.data, sums, starts, ends, lower), bounds


_ROLE = mix(np.arange(101, 133, dtype=U64) * _BASE) | U64(1)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words (over document edges too: the caller cuts)."""
    if len(words) < n:
        return np.empty(0, U64)
    x = words[: len(words) - n + 1] * _ROLE[0]
    for j in range(1, n):
        x = x + words[j : len(words) - n + 1 + j] * _ROLE[j]
    return mix(x)


def shingle_sets(run: Run, n: int = 5) -> Iterator[np.ndarray]:
    """For each document the sorted distinct hashes of its n-word shingles.

    A document of fewer words has its whole sequence as one; without words, none.
    """
    words, bounds = word_hashes(run, lower=True)
    grams = gram_hashes(words, n)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n:
            g = np.sort(grams[a : b - n + 1])
            if len(g) > 1:
                keep = np.empty(len(g), bool)
                keep[0] = True
                np.not_equal(g[1:], g[:-1], out=keep[1:])
                g = g[keep]
            yield g
        elif b > a:
            w = words[a:b]
            x = (w * _ROLE[8 : 8 + b - a]).sum(dtype=U64, keepdims=True)
            yield mix(x + np.full(1, b - a, U64) * _BASE)
        else:
            yield np.empty(0, U64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


_slot: tuple[Any, Any] = (None, None)


def worker_slot(key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept in this Python worker until another key asks.

    Workers are reused by later stages and operators: with one slot, the cache of one never adds
    to that of the next, and what is dropped goes back to the system.
    """
    global _slot
    if _slot[0] != key:
        if _slot[0] is not None:
            _slot = (None, None)
            release()
        _slot = (key, make())
    return _slot[1]


def release() -> None:
    """Gives freed memory back to the system, where it can be given back."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
