"""Texts of an Arrow batch as one byte buffer, with vectorised word spans and prefix hashes.

All Arrow-side operators see their texts through this module: a batch becomes a
``uint8`` array plus document offsets, and everything after that is NumPy over
whole chunks of a few megabytes, so memory in a task does not depend on how
many or how long the documents of a partition are.

The hash of a byte range is polynomial modulo 2**64: with prefix sums
``P[i] = sum(T[c_j] * B**j for j < i)`` the range ``[a, b)`` has the value
``(P[b] - P[a]) * B**-a``, the same wherever the bytes stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
CHUNK_BYTES = 2 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64 (xor-shift and multiply)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * U(_BASE))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


_powers = {"fwd": np.ones(1, np.uint64), "inv": np.ones(1, np.uint64)}


def powers(n: int, kind: str) -> np.ndarray:
    """First ``n`` powers of the base (``fwd``) or of its inverse (``inv``), grown on demand."""
    if len(_powers[kind]) < n:
        p = np.full(max(n, CHUNK_BYTES + (1 << 16)), _BASE if kind == "fwd" else _INV, np.uint64)
        p[0] = 1
        _powers[kind] = np.cumprod(p, dtype=np.uint64)
    return _powers[kind][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums P of length len(data) + 1."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(len(data), "fwd"), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the byte ranges [a, b); ranges of other lengths are told apart by the mixed-in length."""
    h = (prefix[b] - prefix[a]) * powers(len(prefix), "inv")[a]
    return mix64(h + (b - a).astype(np.uint64))


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES,
           docs: int = 1 << 14) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split into runs of at most ``docs`` whole documents of about ``limit`` bytes: (first, end, bytes, offsets)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = min(i + docs, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes with ``is_word`` true inside one document.

    Returns (starts, ends, first): run numbers ``first[d]:first[d + 1]`` belong to document d.
    """
    m = is_word[data]
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start = m.copy()
    start[1:] &= ~m[:-1] | cut[1:n]
    end = m.copy()
    end[:-1] &= ~m[1:] | cut[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offsets).astype(np.int64)


def byte_class(inside) -> np.ndarray:
    """256-entry mask from a predicate on byte values."""
    return np.array([bool(inside(b)) for b in range(256)])


#: Words are runs of anything but space and \t \n \v \f \r.
NON_SPACE = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Words are runs of ASCII letters, digits and all bytes of non-ASCII characters.
ALNUM = byte_class(lambda b: b >= 0x80 or chr(b).isalnum())


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n-word shingle of every document, repeats included: (hashes, first per document).

    A document of fewer words, but not none, has its whole sequence as its only
    shingle (told apart from longer ones by the number of words).
    """
    data = LOWER[data]
    s, e, first = spans(data, offsets, NON_SPACE)
    w = range_hash(prefix_hash(data), s, e)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < n))
    full = np.maximum(count - n + 1, 0)
    total = np.where(count > 0, np.maximum(full, 1), 0)
    out_first = np.concatenate([[0], np.cumsum(total)]).astype(np.int64)
    out = np.zeros(out_first[-1], np.uint64)
    docs = np.flatnonzero(full)
    if len(docs):
        at = np.repeat(first[docs] - np.concatenate([[0], np.cumsum(full[docs])[:-1]]), full[docs]) + np.arange(full[docs].sum())
        h = mix64(w[at] + U(n))
        for k in range(1, n):
            h = mix64(h + w[at + k])
        to = np.repeat(out_first[docs] - np.concatenate([[0], np.cumsum(full[docs])[:-1]]), full[docs]) + np.arange(full[docs].sum())
        out[to] = h
    for d in short:
        h = np.array([count[d]], np.uint64)
        h = mix64(w[first[d]:first[d] + 1] + h)
        for k in range(1, count[d]):
            h = mix64(h + w[first[d] + k:first[d] + k + 1])
        out[out_first[d]] = h[0]
    return out, out_first


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each (start, length), concatenated."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    if not len(lengths) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths) + np.arange(ends[-1])
