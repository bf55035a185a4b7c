"""Vectorised text kernels shared by the corpus operators.

Everything works on Arrow string columns without creating a Python object per
word.  A word is a maximal run of bytes other than ASCII white space
(``[^\\x20\\x09-\\x0D]+``); the separators are single bytes, so UTF-8 text can be
cut byte-wise.  Word identity is a 64-bit polynomial hash over randomised byte
values, finished with a full avalanche; a shingle hash combines word hashes with
odd multipliers.  Null text counts as empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; bounds the scratch arrays of a Python worker.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (the public splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n pseudo-random odd 64-bit constants made from a seed by rule."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=U64) * U64(_BASE) + U64(seed)) | U64(1)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    plain = constants(256, 101)
    lower = plain.copy()
    lower[65:91] = plain[97:123]
    return plain, lower


_PLAIN, _LOWER = _tables()
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Separators of the punctuation-blind reading: everything ASCII but letters and digits.
_NOT_ALNUM = np.ones(256, dtype=bool)
_NOT_ALNUM[48:58] = _NOT_ALNUM[65:91] = _NOT_ALNUM[97:123] = False
_NOT_ALNUM[128:] = False
_SHINGLE = constants(64, 202)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = max(n, 2 * CHUNK)
        with np.errstate(over="ignore"):
            up = np.full(m, U64(_BASE))
            up[0] = 1
            down = np.full(m, U64(pow(_BASE, -1, 1 << 64)))
            down[0] = 1
            _powers[:] = [np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)]
    return _powers[0], _powers[1]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, zero-copy where Arrow allows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None and len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def slices(off: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer row stands alone."""
    n, at = len(off) - 1, 0
    while at < n:
        end = int(np.searchsorted(off, off[at] + limit, "right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end


def _hash_block(d: np.ndarray, begin: np.ndarray, lower: bool, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of a block; begin marks rows' first bytes."""
    inside = ~sep[d]
    left = np.empty(len(d), dtype=bool)
    left[0] = True
    np.logical_not(inside[:-1], out=left[1:])
    left[begin] = True
    left &= inside
    right = np.empty(len(d), dtype=bool)
    right[-1] = True
    np.logical_not(inside[1:], out=right[:-1])
    right[begin[begin > 0] - 1] = True
    right &= inside
    start, end = np.flatnonzero(left), np.flatnonzero(right) + 1
    up, down = _power_tables(len(d) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(d) + 1, dtype=U64)
        np.cumsum((_LOWER if lower else _PLAIN)[d] * up[: len(d)], out=total[1:])
        return mix64((total[end] - total[start]) * down[start] + (end - start).astype(U64)), start, end


def words(raw: np.ndarray, off: np.ndarray, lower: bool = True, sep: np.ndarray = _SPACE, places: bool = False):
    """Word hashes of the rows off[0..n]: (hashes, first) where row i has hashes[first[i]:first[i+1]].

    With places, also the start and end byte of each word, counted from off[0].
    A row of any length is cut at separators into blocks, so scratch memory stays bounded
    by the block and the longest word.
    """
    base, n = int(off[0]), len(off) - 1
    parts, rel = [], np.asarray(off) - base
    d, at, size = raw[base : int(off[-1])], 0, int(off[-1]) - base
    while at < size:
        end = min(size, at + 2 * CHUNK)
        if end < size:
            cut = np.flatnonzero(sep[d[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
            else:  # one word longer than a block
                nxt = np.flatnonzero(sep[d[end:]])
                end = end + int(nxt[0]) + 1 if len(nxt) else size
        lo, hi = np.searchsorted(rel, [at, end])
        begin = rel[lo:hi] - at
        h, s, e = _hash_block(d[at:end], begin[begin < end - at], lower, sep)
        parts.append((h, s + at, e + at))
        at = end
    if parts:
        h, s, e = (np.concatenate(x) for x in zip(*parts))
    else:
        h, s, e = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.searchsorted(s, rel)
    return (h, first, s, e) if places else (h, first)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words (runs across rows included: mask them)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = h[:m] * _SHINGLE[0]
        for j in range(1, n):
            out += h[j : j + m] * _SHINGLE[j]
        return mix64(out)


def shingle_sets(column, n: int, lower: bool = True, sep: np.ndarray = _SPACE) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, [sorted distinct shingle hashes of each row]) block by block.

    A row with fewer than n words has its whole sequence as one shingle; one without
    words has none.
    """
    raw, off = utf8(column)
    for a, b in slices(off):
        h, first = words(raw, off[a : b + 1], lower, sep)
        w = windows(h, n)
        out = []
        for i in range(b - a):
            s, e = int(first[i]), int(first[i + 1])
            if e - s >= n:
                x = np.sort(w[s : e - n + 1])
            elif e > s:
                with np.errstate(over="ignore"):
                    x = mix64(np.array([np.sum(h[s:e] * _SHINGLE[: e - s]) + U64(0xA5A5 + e - s)], dtype=U64))
            else:
                out.append(np.zeros(0, U64))
                continue
            if len(x) > 1:
                keep = np.empty(len(x), dtype=bool)
                keep[0] = True
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                x = x[keep]
            out.append(x)
        yield a, out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
