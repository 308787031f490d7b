"""Vectorised splitting and hashing of UTF-8 text in numpy, over blocks of an Arrow string column.

Words are the runs of bytes other than space and \\t..\\r, as in the pattern ``[^\\x20\\x09-\\x0D]+``.  A word of up to eight bytes
is one 64-bit number, so no two of a length share a hash; further bytes go through a bijective, non-linear round per eight bytes, and
words of more than ``LONG_BYTES`` through keyed BLAKE2b.  An n-gram's hash mixes its word hashes.  The hashes depend on nothing but
the bytes, so all workers agree.  (Sums of byte times power, as ``_powers`` serves, collide modulo 2**64 for words that can be
written down at once; they are good for choosing buckets only.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Text bytes that are processed at once; one longer text forms a block of its own.
BLOCK_BYTES = 1 << 20
#: Bytes up to which words are hashed by array rounds; a longer one is hashed by itself.
LONG_BYTES = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_STEP = [np.uint64(x | 1) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words whose every output bit depends on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SIZES = mix(np.arange(LONG_BYTES + 1, dtype=np.uint64) * _STEP[0] + _BASE)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


@lru_cache(maxsize=4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for 2**bits places."""
    inverse = pow(int(_BASE), -1, 1 << 64)
    out = []
    for base in (int(_BASE), inverse):
        x = np.full(1 << bits, np.uint64(base))
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) over a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def lanes(raw: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The bytes from each place on, eight at most and no more than are ``left``, as one number each."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    every = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    return every[at] & _MASK[np.minimum(left, 8)]


def span_hashes(raw: np.ndarray, s: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, first eight bytes as a number) of each span of ``size`` bytes from ``s`` on."""
    first = lanes(raw, s, size)
    hashed = mix(_SIZES[np.minimum(size, LONG_BYTES)] ^ first)
    for k in range(8, LONG_BYTES, 8):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        hashed[more] = mix((hashed[more] * _STEP[1]) ^ lanes(raw, s[more] + k, size[more] - k))
    for i in np.flatnonzero(size > LONG_BYTES):
        hashed[i] = int.from_bytes(hashlib.blake2b(raw[s[i] : s[i] + size[i]].tobytes(), digest_size=8, key=b"word").digest(), "little")
    return hashed, first


def words(raw: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text), words in the order of the texts."""
    n = len(raw)
    docs = len(offs) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(docs, np.int64)
    if lower:
        raw = _LOWER[raw]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    ink = ~_SPACE[raw]
    begin = ink.copy()
    begin[1:] &= ~ink[:-1] | edge[1:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:] | edge[1:-1]
    s, e = np.flatnonzero(begin), np.flatnonzero(last) + 1
    hashed, _ = span_hashes(raw, s, e - s)
    return hashed, np.bincount(np.searchsorted(offs, s, side="right") - 1, minlength=docs)


def ngrams(hashed: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all n-grams, number of each text).  A text of fewer words has its whole sequence as one n-gram."""
    ends = np.cumsum(counts)
    starts = ends - counts
    each = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    out_ends = np.cumsum(each)
    total = int(out_ends[-1]) if len(out_ends) else 0
    at = np.arange(total, dtype=np.int64) + np.repeat(starts - (out_ends - each), each)
    width = np.repeat(np.minimum(counts, n), each)
    acc = np.zeros(total, np.uint64)
    padded = np.concatenate([hashed, np.zeros(n, np.uint64)])
    for k in range(n):
        acc += np.where(k < width, padded[at + k], np.uint64(0)) * _STEP[k]
    return mix(acc + width.astype(np.uint64)), each


def shingle_sets(column: pa.Array, n: int, lower: bool = True) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its word n-grams."""
    for i, j, raw, offs in blocks(column):
        grams, each = ngrams(*words(raw, offs, lower), n)
        ends = np.cumsum(each)
        for a, b in zip(ends - each, ends, strict=True):
            yield np.unique(grams[a:b])


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as Spark's long."""
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)
