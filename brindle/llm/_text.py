"""Whole-batch text primitives over Arrow buffers: words, word hashes, window hashes.

Everything here works on the UTF-8 bytes of many documents at once, so no Python object is made
for a word or a character. Hashes are 64-bit: each byte goes through a table of random numbers,
windows are polynomial (Rabin-Karp) modulo 2**64 over those, and the result is scrambled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Text is worked on in pieces of about so many bytes; a longer document is a piece of its own.
PIECE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit scramble (the finalizer of splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def randoms(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed * 0x632BE59BD9B4E019 % 2**64))


class _Tables:
    """Powers of an odd base and of its inverse, and position multipliers; all grow on demand."""

    base = 0xD6E8FEB86659FD93
    pw = inv = np.ones(1, U)
    pos = np.zeros(0, U)

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.pw) < n:
            m = max(n, 2 * len(cls.pw), 1 << 16)
            b = np.full(m, U(cls.base))
            b[0] = U(1)
            i = np.full(m, U(pow(cls.base, -1, 2**64)))
            i[0] = U(1)
            cls.pw, cls.inv = np.multiply.accumulate(b), np.multiply.accumulate(i)
        return cls.pw, cls.inv

    @classmethod
    def positions(cls, n: int) -> np.ndarray:
        if len(cls.pos) < n:
            cls.pos = randoms(max(n, 2 * len(cls.pos), 4096), 7) | U(1)
        return cls.pos


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words that are anything but white space.
TOKEN = ~SPACE
#: Bytes of words of digits, ASCII letters (either case) and all characters from U+0080.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_BYTE = randoms(256, 1)


def strings(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's start in them (one more at the end). Null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, pa.scalar("", col.type))
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, kind, len(col) + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64) if len(col) else np.zeros(1, np.int64)
    if data is None or o[-1] == o[0]:
        return np.zeros(0, np.uint8), o - o[0]
    return np.frombuffer(data, np.uint8, int(o[-1] - o[0]), int(o[0])), o - o[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches with about ``size`` bytes of text each."""
    for b in batches:
        col = b.column(b.schema.get_field_index(text))
        _, o = strings(col)
        a = 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(o, o[a] + size, "right")) - 1)
            yield b.slice(a, z - a)
            a = z


def words(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word: a longest run of bytes that ``table`` marks, inside one row."""
    n = len(buf)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    w = table[buf]
    p = np.empty(n, bool)
    p[0] = False
    p[1:] = w[:-1]
    p[offs[:-1][offs[:-1] < n]] = False
    starts = np.flatnonzero(w & ~p)
    p[-1] = False
    p[:-1] = w[1:]
    p[offs[1:][offs[1:] > 0] - 1] = False
    ends = np.flatnonzero(w & ~p) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes, ASCII letters folded to lower case if asked."""
    if not len(starts):
        return np.zeros(0, U)
    a = starts[0]
    gap = np.diff(starts, append=len(buf))
    at = np.arange(a, len(buf)) - np.repeat(starts, gap)
    inside = at < np.repeat(ends - starts, gap)
    t = _BYTE[LOWER] if lower else _BYTE
    v = t[buf[a:]] * _Tables.positions(int(gap.max()))[at]
    v *= inside
    return mix(np.add.reduceat(v, starts - a) + (ends - starts).astype(U))


def prefix(sym: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial over ``sym``; see span_hashes."""
    pw, _ = _Tables.powers(len(sym) + 1)
    out = np.empty(len(sym) + 1, U)
    out[0] = 0
    np.cumsum(sym * pw[: len(sym)], out=out[1:])
    return out


def span_hashes(pre: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Polynomial hashes, not scrambled, of the symbols [a, z); equal spans have equal hashes."""
    _, inv = _Tables.powers(len(pre))
    return (pre[z] - pre[a]) * inv[a]


def rolling(pre: np.ndarray, k: int) -> np.ndarray:
    """Scrambled hashes of all windows of k symbols."""
    n = len(pre) - 1
    if n < k:
        return np.zeros(0, U)
    _, inv = _Tables.powers(len(pre))
    return mix((pre[k:] - pre[: n - k + 1]) * inv[: n - k + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive numbers."""
    if len(x) < w:
        return x[:0]
    m, have = x, 1
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = w - have
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)
