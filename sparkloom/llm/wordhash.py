"""Vectorised word splitting and hashing over Arrow text columns.

Words are maximal runs of "word bytes" of the UTF-8 text. Every word gets a 64-bit hash, computed for a whole block of
documents at once from one prefix sum over its bytes (a polynomial with a random value per byte, modulo 2**64), so that no
Python code runs per word. As such polynomials have systematic collisions from about 1000 bytes on, words longer than `LONG` bytes
are hashed by BLAKE2 instead. Two given different words share a hash with a chance of about 2**-60. A row is never divided: a text
of n bytes takes about 60 n bytes of memory while it is hashed.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

LONG = 256
_rng = np.random.default_rng(71)
BYTES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED = BYTES.copy()
FOLDED[65:91] = BYTES[97:123]

_all = np.arange(256)
#: `[^\x20\x09-\x0D]+`
NOT_SPACE = ~((_all == 0x20) | ((_all >= 0x09) & (_all <= 0x0D)))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z
ALNUM = ((_all >= 0x30) & (_all <= 0x39)) | ((_all >= 0x41) & (_all <= 0x5A)) | ((_all >= 0x61) & (_all <= 0x7A)) | (_all >= 0x80)

_BASE = 0x9E3779B97F4A7C15
_M1, _M2, _K = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 20)
        up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _powers[0], _powers[1]


_lean = False


def keep_lean() -> None:
    """Has arrays of 8 MB and more mapped one by one, so that a worker gives their memory back when they go. Once per process."""
    global _lean
    if _lean:
        return
    _lean = True
    pa.set_memory_pool(pa.system_memory_pool())
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)  # glibc has it
    if mallopt is not None:
        mallopt(-3, 8 << 20)
        mallopt(-1, 32 << 20)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same map over batches, which gives back what memory the worker holds unused when it ends."""

    def wrapped(batches: Iterator) -> Iterator:
        keep_lean()
        yield from run(batches)
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return wrapped


def blocks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `limit` bytes: first row, end row, the bytes, the rows' offsets in them. Null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        hi = min(hi, n, lo + 20_000)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words(buf: np.ndarray, off: np.ndarray, table: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends (bytes) of all words, and each row's range of words."""
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(off), np.int64)
    w = np.zeros(n + 2, np.int8)
    w[1:-1] = is_word[buf]
    step = np.diff(w)  # at i: 1 where a word starts at i, -1 where one ended before i
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inner = off[1:-1]
    cut = np.unique(inner[(inner > 0) & (inner < n)])
    cut = cut[(w[cut] == 1) & (w[cut + 1] == 1)]  # a word would run across two rows
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(table[buf] * up[:n], out=total[1:])
    h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _K)
    for k in np.flatnonzero(ends - starts > LONG).tolist():
        word = buf[starts[k] : ends[k]].tobytes()
        h[k] = int.from_bytes(hashlib.blake2b(word.lower() if table is FOLDED else word, digest_size=8).digest(), "little")
    return h, starts, ends, np.searchsorted(starts, off)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words (by their first word); windows that run across rows must be masked by the caller."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    up, down = powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    n = len(h) - k + 1
    return mix((total[k:] - total[:n]) * down[:n] + _K * np.full(1, k, np.uint64))


def span_hasher(buf: np.ndarray, table: np.ndarray):
    """A function (starts, ends) -> hashes of those spans of bytes."""
    up, down = powers(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(table[buf] * up[: len(buf)], out=total[1:])
    return lambda starts, ends: mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _K)
