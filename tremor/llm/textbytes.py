"""Vectorised byte-level text helpers used inside Arrow tasks.

Everything here works on one Arrow batch (bounded by Spark's Arrow batch limits) and cuts it into
chunks of whole documents of about ``CHUNK_BYTES``; nothing is kept between batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
WORD_CODE = _rng.integers(1, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; kept per process and grown on demand."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.full(max(n, CHUNK_BYTES * 2) + 1, np.uint64(base), dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[: n + 1]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bijective 64-bit finaliser, so that any bits of the result can be used for dealing out."""
    x = x + np.uint64(salt & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array without copying it; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8), at.astype(np.int64)


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``limit`` bytes; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """C[0..n] with C[k] = sum of code(byte j) * BASE**j for j < k, modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * powers(BASE, len(data))[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, independent of where the span stands."""
    return (prefix[end] - prefix[start]) * powers(BASE_INV, len(prefix) - 1)[start]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document index) of the words ``[^\\x20\\x09-\\x0D]+`` of a chunk; offsets start at 0."""
    ink = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = ink.copy()
    begin[1:] &= ~ink[:-1] | edge[1:-1]
    stop = ink.copy()
    stop[:-1] &= ~ink[1:] | edge[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document index) of every word of a chunk, A-Z lower-cased."""
    low = LOWER[data]
    start, end, doc = words(low, offsets)
    return span_hash(prefix_hash(low), start, end), doc


def shingles(word_hash: np.ndarray, doc: np.ndarray, n_docs: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document index) of every run of ``size`` words; a shorter document gives its whole sequence."""
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(count)])
    out_h, out_d = [], []
    if len(word_hash) >= size:
        n = len(word_hash) - size + 1
        whole = np.zeros(n, np.uint64)
        for j in range(size):
            whole += word_hash[j : j + n] * WORD_CODE[j]
        inside = doc[:n] == doc[size - 1 :]
        out_h.append(mix(whole[inside]))
        out_d.append(doc[:n][inside])
    for k in range(1, size):
        short = np.flatnonzero(count == k)
        if len(short):
            whole = np.zeros(len(short), np.uint64)
            for j in range(k):
                whole += word_hash[first[short] + j] * WORD_CODE[j]
            out_h.append(mix(whole, salt=k * 0x5851F42D4C957F2D))
            out_d.append(short)
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_h), np.concatenate(out_d).astype(np.int64)


def distinct_sets(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (document, hash) pairs, by document and then by hash."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], doc[keep]
