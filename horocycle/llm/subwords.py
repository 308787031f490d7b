"""Hashed character n-grams of words, computed for whole blocks of text in numpy.

A word is a run of ASCII letters and digits or bytes above 0x7F, lower-cased (ASCII and Latin-1 letters), with a space on
either side; its n-grams are the byte n-grams of that, so they tell beginnings and ends of words from their middles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from horocycle.llm import textkit

BLOCK_BYTES = 1 << 19

_WORD = np.full(256, 32, np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _WORD[_b] = _b
for _b in range(65, 91):
    _WORD[_b] = _b + 32


def grams(column: pa.Array, orders: tuple[int, ...], whole: bool, buckets: int) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """Yield (first row, end row, parts); a part is (bucket of each n-gram, end of each text in it) of one order.

    ``buckets`` is a power of two; with ``whole`` the last part has the words themselves.
    """
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    for i, j, raw, offs in textkit.blocks(column, BLOCK_BYTES):
        docs = j - i
        # One space after each text and one before the first, so that no n-gram crosses texts.
        text = np.full(len(raw) + docs + 1, 32, np.uint8)
        place = np.arange(len(raw)) + np.repeat(np.arange(1, docs + 1), np.diff(offs))
        text[place] = _WORD[raw]
        accent = (text[1:] >= 0x80) & (text[1:] <= 0x9E) & (text[1:] != 0x97) & (text[:-1] == 0xC3)
        text[1:][accent] += 32
        ends = offs[1:] + np.arange(1, docs + 1)  # place of the space after each text
        n = len(text)
        space = text == 32
        power, inverse = textkit._powers(max(20, int(n).bit_length()))
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(textkit._BYTE[text] * power[:n], dtype=np.uint64, out=run[1:])
        gaps = np.zeros(n + 1, np.int32)
        np.cumsum(space, out=gaps[1:])
        parts = []
        for size in orders:
            if n < size:
                parts.append((np.zeros(0, np.int64), np.zeros(docs, np.int64)))
                continue
            m = n - size + 1
            ok = gaps[size - 1 : size - 1 + m] == gaps[1 : 1 + m] if size > 2 else ~(space[:m] & space[1 : 1 + m])
            if size > 2:
                ok &= ~(space[1 : 1 + m] if size == 2 else np.zeros(1, bool))
            at = np.flatnonzero(ok)
            key = textkit.mix((run[at + size] - run[at]) * inverse[at] + np.uint64(size)) >> shift
            parts.append((key.astype(np.int64), np.searchsorted(at, ends)))
        if whole:
            begin = np.flatnonzero(space[:-1] & ~space[1:]) + 1
            end = np.flatnonzero(~space[:-1] & space[1:]) + 1
            key = textkit.mix((run[end] - run[begin]) * inverse[begin] + np.uint64(0xABCDEF)) >> shift
            parts.append((key.astype(np.int64), np.searchsorted(begin, ends)))
        yield i, j, parts


def bags(column: pa.Array, orders: tuple[int, ...], whole: bool, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, counts) of each text."""
    out = []
    for i, j, parts in grams(column, orders, whole, buckets):
        for row in range(j - i):
            own = [key[(end[row - 1] if row else 0) : end[row]] for key, end in parts]
            found, counts = np.unique(np.concatenate(own), return_counts=True)
            out.append((found.astype(np.int32), counts.astype(np.int32)))
    return out


def averages(column: pa.Array, orders: tuple[int, ...], whole: bool, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean of ``table`` rows over each text's n-grams, their number); a text without n-grams has zeros."""
    width = table.shape[1]
    total, count = np.zeros((len(column), width)), np.zeros(len(column), np.int64)
    for i, j, parts in grams(column, orders, whole, len(table)):
        for key, end in parts:
            begin = np.concatenate([[0], end[:-1]])
            count[i:j] += end - begin
            full = end > begin
            if full.any():
                for k in range(width):
                    total[i:j, k][full] += np.add.reduceat(table[:, k][key], begin[full], dtype=np.float64)
    return total / np.maximum(count, 1)[:, None], count
