"""Vectorised text kernels on the UTF-8 bytes of an Arrow string column.

Everything here works on one flat byte array for many texts, so the Python
cost is per batch and not per row. Hashes are 64-bit polynomials over random
symbol values, read off prefix sums: the hash of any substring costs O(1).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U64 = np.uint64
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
LAST = U64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that close inputs give unrelated hashes."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def _odd_values(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(ODD[seed % 3]) + U64(seed * 7919 + 1)) | U64(1)


class Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inv = U64(base), U64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inv)):
                p = np.full(size, b, U64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up, self.down


class Rolling:
    """Substring hashes of a sequence of 64-bit symbol values."""

    powers = {0: Powers(0x2545F4914F6CDD1D), 1: Powers(0x9FB21C651E98DF25)}

    def __init__(self, values: np.ndarray, family: int = 0) -> None:
        self.p, self.q = self.powers[family].get(len(values) + 1)
        self.c = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self.p[: len(values)], out=self.c[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.c[end] - self.c[start]) * self.q[start] + (end - start).astype(U64))

    def windows(self, k: int) -> np.ndarray:
        """The hash of every k consecutive symbols."""
        n = len(self.c) - 1
        if n < k:
            return np.zeros(0, U64)
        h = self.c[k:] - self.c[:-k]
        h *= self.q[: n - k + 1]
        return mix(h + U64(k))


BYTE_VALUES = {f: _odd_values(256, 11 + f) for f in (0, 1)}


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind, column = np.int64, column
    else:
        kind = np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def chunks(buf: np.ndarray, offsets: np.ndarray, limit: int = 1 << 19):
    """Ranges of whole texts of about limit bytes: (first, last, bytes, offsets). A longer text is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_table(pattern_bytes: bytes, inside: bool = True) -> np.ndarray:
    t = np.full(256, not inside)
    t[np.frombuffer(pattern_bytes, np.uint8)] = inside
    return t


#: Words of [^\x20\x09-\x0D]+ .
SPACED = word_table(bytes([0x20, *range(0x09, 0x0E)]), inside=False)
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased.
ALNUM = word_table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def words(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, word offsets): byte bounds of each word, and where each text's words begin."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = table[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = inside
    now = np.empty(n + 1, bool)
    now[:-1] = inside
    now[-1] = False
    start = np.flatnonzero(now & (~before | edge))
    end = np.flatnonzero(before & (~now | edge))
    return start, end, np.searchsorted(start, offsets)


def word_values(buf: np.ndarray, start: np.ndarray, end: np.ndarray, family: int = 0) -> np.ndarray:
    return Rolling(BYTE_VALUES[family][buf], family).span(start, end)


def invalid_starts(total: int, offsets: np.ndarray, k: int) -> np.ndarray:
    """Which of the total-k+1 windows of k symbols reach over the end of their text."""
    n = total - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    d = np.zeros(n + 1, np.int32)
    lo = np.maximum(offsets[1:] - k + 1, offsets[:-1])
    lo, hi = np.minimum(lo, n), np.minimum(offsets[1:], n)
    np.add.at(d, lo, 1)
    np.add.at(d, hi, -1)
    return np.cumsum(d[:-1]) > 0


def sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over every w consecutive elements, by doubling."""
    m, span = x, 1
    while span * 2 <= w:
        m = op(m[:-span], m[span:])
        span *= 2
    return op(m[: len(x) - w + 1], m[w - span : w - span + len(x) - w + 1]) if w > span else m


def winnow(values: np.ndarray, offsets: np.ndarray, window: int, k: int, family: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints that equal windows share, wherever they are.

    Returns (least, bad, anchors): the smallest hash of the k-grams of every
    window, which windows reach over the end of a text, and the hashes of all
    k-grams that are the smallest of some window, one for each position.
    The smallest hashes crowd near 0, so they are mixed once more to spread.
    """
    n = len(values)
    if n < window:
        z = np.zeros(0, U64)
        return z, np.zeros(0, bool), z
    x = Rolling(values, family).windows(k)
    least = sliding(x, window - k + 1, np.minimum)
    bad = invalid_starts(n, offsets, window)
    seen = np.where(bad, U64(0), least)
    pad = np.zeros(window - k, U64)
    most = sliding(np.concatenate([pad, seen, pad]), window - k + 1, np.maximum)
    return mix(least ^ U64(ODD[1])), bad, mix(x[x == most] ^ U64(ODD[1]))


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, count of each)."""
    return np.unique(x, return_counts=True)


def is_in(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Membership in a sorted array."""
    if not len(keys):
        return np.zeros(len(x), bool)
    i = np.searchsorted(keys, x)
    i[i == len(keys)] = 0
    return keys[i] == x


def cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions the half-open ranges cover."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0


def runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each run of true values."""
    e = np.flatnonzero(np.diff(np.concatenate([[False], flag, [False]]).astype(np.int8)))
    return e[::2], e[1::2]


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
