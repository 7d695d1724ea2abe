"""Vectorised word hashing over Arrow string columns.

A batch's texts lie in one UTF-8 buffer; words are found and hashed with numpy
straight on that buffer, so no Python object is made per word. A word's hash
depends on its bytes alone, so it is the same in every batch, task and run.
"""

from __future__ import annotations

import ctypes
import functools
import sys

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes hashed at a time; bounds the temporary arrays, whatever a text's length.
CHUNK = 1 << 20
_P = 0x9E3779B97F4A7C55
_MASK = (1 << 64) - 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Words are runs of anything but ASCII white space (space, tab to carriage return).
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Words are runs of ASCII letters, digits and non-ASCII characters.
_NON_WORD = np.ones(256, bool)
_NON_WORD[0x30:0x3A] = _NON_WORD[0x41:0x5B] = _NON_WORD[0x61:0x7B] = False
_NON_WORD[0x80:] = False


def _table(gaps: np.ndarray, fold: bool) -> np.ndarray:
    values = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)
    if fold:
        values[0x41:0x5B] = values[0x61:0x7B]
    values[gaps] = 0
    return values


#: Name -> (is the byte a gap between words?, the byte's 64-bit value, 0 for gaps).
STYLES = {
    "space": (_SPACE, _table(_SPACE, False)),
    "space_folded": (_SPACE, _table(_SPACE, True)),
    "alnum_folded": (_NON_WORD, _table(_NON_WORD, True)),
}

#: Maps bytes to lower-cased words and single blanks, for bytes.split().
ALNUM_FOLD = bytes(0x20 if _NON_WORD[b] else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def mix(h: np.ndarray) -> np.ndarray:
    """Final avalanche of a 64-bit hash; a bijection."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def powers(n: int, base: int = _P) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, U), np.full(size, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        have = np.cumprod(up), np.cumprod(down)
        if size <= 2 * CHUNK:
            _POWERS[base] = have
    return have


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its len + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = 4 * CHUNK):
    """Ranges of rows of about `limit` bytes each; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def spans(data: np.ndarray, offsets: np.ndarray, style: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in the buffer, and len + 1 offsets of each row's words."""
    gap = STYLES[style][0][data]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first = ~gap
    if len(data):
        first[1:] &= gap[:-1]
        first[inner] = ~gap[inner]
    starts = np.flatnonzero(first)
    last = ~gap
    if len(data):
        last[:-1] &= gap[1:]
        last[inner - 1] = ~gap[inner - 1]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, style: str) -> np.ndarray:
    """A 64-bit hash of each word, from its bytes alone."""
    values, out, i = STYLES[style][1], np.empty(len(starts), U), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = powers(b - a)
        total = np.zeros(b - a + 1, U)
        np.cumsum(values[data[a:b]] * up[: b - a], out=total[1:])
        s = starts[i:j] - a
        out[i:j] = (total[ends[i:j] - a] - total[s]) * down[s]
        i = j
    return mix(out)


def words(column: pa.Array, style: str):
    """Word hashes of a column and each row's offsets into them."""
    data, offsets = buffers(column)
    starts, ends, at = spans(data, offsets, style)
    return hashes(data, starts, ends, style), at


def ngrams(word: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of the n words from each position; len - n + 1 of them, over row borders too."""
    if len(word) < n:
        return np.zeros(0, U)
    base = _P + 2 * 0x1F3D5B79 * seed & _MASK | 1
    out = np.zeros(len(word) - n + 1, U)
    for k in range(n):  # Horner's rule
        out *= U(base)
        out += word[k : len(word) - n + 1 + k]
    return mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def lean(step):
    """A worker's generator that gives freed memory back to the system at its end, as an idle worker keeps it else."""

    @functools.wraps(step)
    def run(*args, **named):
        yield from step(*args, **named)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
        if trim is not None:
            trim(0)

    return run
