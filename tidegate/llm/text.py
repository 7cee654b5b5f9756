"""Vectorised byte and word helpers for Arrow string columns inside tasks.

Hashes are polynomial over bytes modulo 2**64 with an odd base, so that the hash of any substring comes from two
prefix sums, and are then mixed. They are 64 bits wide: two given strings collide with probability about 2**-64.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
BASE_INV = U(pow(int(BASE), -1, 1 << 64))
CHUNK = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: bytes of words made of ASCII digits, lower-case ASCII letters and everything beyond ASCII
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers: dict[str, np.ndarray] = {}


def release() -> None:
    """Give freed memory back to the system: workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def tidy(f):
    """A grouped function of one or two tables that gives memory back when its group is done."""

    def call(*tables):
        try:
            return f(*tables)
        finally:
            release()

    return (lambda t: call(t)) if f.__code__.co_argcount == 1 else (lambda a, b: call(a, b))


def _series(b: np.uint64, n: int) -> np.ndarray:
    x = np.full(n, b, U)
    x[0] = 1
    return np.cumprod(x, dtype=U)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n. The worker keeps those of a usual chunk, no longer ones."""
    most = CHUNK + 4096
    if n > most:
        return _series(BASE, n), _series(BASE_INV, n)
    if not _powers:
        _powers.update(up=_series(BASE, most), down=_series(BASE_INV, most))
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64-bit values."""
    x = np.asarray(x, U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n+1 offsets; null is the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays([c.cast(pa.large_binary()) for c in col.chunks]) if col.num_chunks else pa.array([], pa.large_binary())
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = col.buffers()
    off = np.frombuffer(at, np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, limit: int = CHUNK):
    """Ranges [a, b) of rows holding at most ``limit`` bytes each, or one row that is longer."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = hash of data[i:j] times BASE**i."""
    up, _ = powers(len(data) + 1)
    out = np.empty(len(data) + 1, U)
    out[0] = 0
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of each data[start:end]."""
    _, down = powers(len(h))
    return mix((h[end] - h[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-row offsets of maximal runs of bytes for which ``inside`` holds; runs never cross rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    s = inside.copy()
    s[1:] &= ~inside[:-1]
    e = inside.copy()
    e[:-1] &= ~inside[1:]
    full = off[1:] > off[:-1]
    s[off[:-1][full]] = inside[off[:-1][full]]
    e[off[1:][full] - 1] = inside[off[1:][full] - 1]
    starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
    return starts, ends, np.searchsorted(starts, off)


def space_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, and per-row offsets."""
    low = LOWER[data]
    starts, ends, at = words(low, off, ~SPACE[low])
    return span_hash(prefix_hash(low), starts, ends), at


def row_of(at: np.ndarray) -> np.ndarray:
    """Row number of each element, from per-row offsets."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of values in each row, from per-row offsets; empty rows give 0."""
    c = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    return c[at[1:]] - c[at[:-1]]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
