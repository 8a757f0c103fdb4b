"""Texts of Arrow batches as byte arrays: bounded blocks, words, hashes."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 512 << 10     # bytes of text worked on at once (one longer text is one block)

_U = np.uint64
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_views(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(column, limit: int = BLOCK_BYTES):
    """Runs of consecutive texts of at most ``limit`` bytes: (first row,
    end row, bytes, offsets within the block)."""
    raw, off = text_views(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, raw[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); its constants are fixed values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = int(0x9E3779B97F4A7C15)
_INV = pow(_BASE, -1, 1 << 64)
_TABLE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_TABLE_WORDS = np.where(_WS, _U(0), _TABLE[LOWER])
_POWERS: dict = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK_BYTES + 1), _U(base))
        have[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(have)
    return have[:n]


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a block: starts, ends (byte
    positions) and first word number of each text (length texts + 1)."""
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    solid = ~_WS[raw]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word, A-Z lower-cased."""
    if len(starts) == 0:
        return np.zeros(0, _U)
    n = len(raw)
    h = np.add.reduceat(_TABLE_WORDS[raw] * powers(_BASE, n), starts)
    return mix(h * powers(_INV, n)[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def trim() -> None:
    """Give freed memory back to the system at the end of a task: a worker
    lives on and shares the executor's memory with the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):        # not a glibc system
        pass


def trimmed(fn):
    """A mapInArrow function that trims memory when its task ends."""
    def run(batches):
        yield from fn(batches)
        trim()
    return run


def list_array(values: np.ndarray, offsets: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
