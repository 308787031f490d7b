"""Byte-level BPE over batched pre-tokens by rank-synchronous array merging.

A block of text becomes code points, code points become classes, and the boundaries of the pre-tokens follow from the
classes by array operations.  Distinct pre-tokens are held as ragged arrays of symbols; in each round every sequence merges all
(non-overlapping, leftmost first) occurrences of its own lowest-ranked pair at once, until no sequence has a known pair.
A worker remembers the pre-tokens that it has met, up to a bound, so most of a text is one look-up.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horocycle.llm import textkit

_OTHER, _LETTER, _NUMBER, _BLANK, _SPACE = 0, 1, 2, 3, 4  # _BLANK: white space but U+0020
#: Distinct pre-tokens and their symbols that a worker remembers; beyond these it starts anew.
CACHE_WORDS, CACHE_IDS = 1 << 18, 1 << 20
#: Code points that are processed at once; a longer text forms a block of its own.
BLOCK_CHARS = 1 << 19


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    import regex

    points = "".join(map(chr, (x for x in range(0x110000) if not 0xD800 <= x < 0xE000)))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, r"\s+")):
        for m in regex.finditer(pattern, points):
            out[[ord(x) for x in m.group()]] = kind
    out[0x20] = _SPACE
    return out


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def split(points: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of texts of code points, as ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` cuts them."""
    n = len(points)
    kind = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    white = kind >= _BLANK
    prev = np.empty(n, np.uint8)
    prev[0], prev[1:] = 255, kind[:-1]
    prev[first[:n]] = 255
    prev_white = (prev == _BLANK) | (prev == _SPACE)
    begin = first[:n].copy()
    # A run of one class begins where the class changes; after U+0020 it takes that space along.
    begin |= ~white & (kind != prev) & (prev != _SPACE)
    # White space begins at its run; the last of a run that ink follows stands alone, or with the ink.
    begin |= white & ~prev_white
    follows = np.zeros(n, bool)
    follows[:-1] = white[:-1] & ~white[1:] & ~first[1:n]
    begin |= follows
    # Contractions: an apostrophe where a match begins, not after U+0020 and not within a run of its class.
    quotes = np.flatnonzero((points == 0x27) & (prev != _SPACE) & ((prev != _OTHER) | first[:n]))
    if len(quotes):
        pad = np.concatenate([points, np.zeros(2, points.dtype)])
        end = np.searchsorted(offs, quotes, side="right")
        stop = offs[end]
        one, two = pad[quotes + 1], pad[quotes + 2]
        short = np.isin(one, [ord(x) for x in "stmd"]) & (quotes + 1 < stop)
        long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))) & (quotes + 2 < stop)
        size = np.where(short, 2, np.where(long, 3, 0))
        for width in (2, 3):
            at = quotes[size == width]
            for k in range(1, width):
                begin[at + k] = False
            rest = at + width
            rest = rest[rest < n]
            begin[rest] = True
            # U+0020 that follows goes with the next ink as before; an apostrophe that follows is looked at above only
            # if its own run begins there, which it does, as a contraction ends in a letter.
    return np.flatnonzero(begin)


class Table:
    """Open addressing from 64-bit keys to numbers, probed for whole arrays at once."""

    def __init__(self, bits: int) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.numbers = np.full(1 << bits, -1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (((keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(34)) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for unknown ones."""
        slot = self._slot(keys)
        out = self.numbers[slot]
        wrong = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(wrong):
            slot[wrong] = (slot[wrong] + np.uint64(1)) & self.mask
            at = slot[wrong]
            out[wrong] = self.numbers[at]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[at] != keys[wrong])]
        return out

    def put(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        """Add distinct keys that are not there yet."""
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = self.numbers[slot[left]] < 0
            at = left[free]
            self.numbers[slot[at]] = numbers[at]
            self.keys[slot[at]] = keys[at]
            left = left[self.numbers[slot[left]] != numbers[left]]
            slot[left] = (slot[left] + np.uint64(1)) & self.mask


class Vocabulary:
    """Merges of a byte-level BPE vocabulary file (``.json`` of the tokenizers library)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, pre = data["model"], data.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or data.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE files without a normaliser are understood")
        vocab = model["vocab"]
        self.size = 1 + max(vocab.values())
        alphabet = byte_alphabet()
        self.byte = np.zeros(256, np.int64)
        for ch, b in alphabet.items():
            self.byte[b] = vocab[ch]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.made = made  # by rank
        self.pairs = Table(max(12, len(key).bit_length() + 2))
        self.pairs.put(key.astype(np.uint64), np.arange(len(key), dtype=np.int32))
        self.special = {x["content"]: x["id"] for x in data.get("added_tokens", [])}
        self.pattern = re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge ragged sequences of ids until none has a known pair; (ids, lengths)."""
        none = np.int32(1 << 30)
        n = len(lengths)
        done_ids: list[np.ndarray] = []
        done_len: list[np.ndarray] = []
        done_no: list[np.ndarray] = []
        names = np.arange(n)
        while len(lengths):
            ends = np.cumsum(lengths)
            starts = ends - lengths
            total = int(ends[-1])
            rank = np.full(total, none, np.int32)
            if total > 1:
                found = self.pairs.get((symbols[:-1] * self.size + symbols[1:]).view(np.uint64))
                found[found < 0] = none
                found[ends[:-1] - 1] = none
                rank[:-1] = found
            low = np.minimum.reduceat(rank, starts)
            alive = low < none
            if not alive.all():
                stay = ~alive
                mask = np.repeat(stay, lengths)
                done_ids.append(symbols[mask])
                done_len.append(lengths[stay])
                done_no.append(names[stay])
                if not alive.any():
                    break
                mask = ~mask
                symbols, rank = symbols[mask], rank[mask]
                lengths, names, low = lengths[alive], names[alive], low[alive]
                ends = np.cumsum(lengths)
                total = int(ends[-1])
            hit = rank == np.repeat(low, lengths)
            # Of a run of overlapping hits (one symbol repeated) every second one merges, the first included.
            if (hit[1:] & hit[:-1]).any():
                at = np.flatnonzero(hit)
                fresh = np.concatenate([[True], at[1:] != at[:-1] + 1])
                place = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                hit[at[place % 2 == 1]] = False
            at = np.flatnonzero(hit)
            symbols[at] = self.made[rank[at]]
            keep = np.ones(total, bool)
            keep[at + 1] = False
            symbols = symbols[keep]
            owner = np.searchsorted(ends, at, side="right")
            lengths = lengths - np.bincount(owner, minlength=len(lengths))
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids, lens, nos = np.concatenate(done_ids), np.concatenate(done_len), np.concatenate(done_no)
        ends = np.cumsum(lens)
        order = np.argsort(nos, kind="stable")
        lens_sorted = lens[order]
        out_ends = np.cumsum(lens_sorted)
        take = np.arange(len(ids)) + np.repeat((ends - lens)[order] - (out_ends - lens_sorted), lens_sorted)
        return ids[take], lens_sorted


class Encoder:
    """Encodes whole texts block by block; keeps pre-tokens and their ids, found by a hash and compared byte by byte."""

    def __init__(self, path: str) -> None:
        self.vocab = Vocabulary(path)
        self._forget()

    def _forget(self) -> None:
        self.known = Table(CACHE_WORDS.bit_length() + 1)
        self.at, self.len = np.zeros(CACHE_WORDS, np.int32), np.zeros(CACHE_WORDS, np.int32)
        self.ids = np.zeros(CACHE_IDS, np.int32)
        # The bytes of each pre-token: the first eight as a number, and all of a longer one from ``byte_at`` on.
        self.size, self.lane, self.byte_at = np.zeros(CACHE_WORDS, np.int32), np.zeros(CACHE_WORDS, np.uint64), np.zeros(CACHE_WORDS, np.int32)
        self.bytes = np.zeros(CACHE_IDS, np.uint8)
        self.n_words = self.n_ids = self.n_bytes = 0

    def _learn(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Numbers of pre-tokens that are new."""
        ends = np.cumsum(lengths)
        take = np.arange(int(ends[-1])) + np.repeat(starts - (ends - lengths), lengths)
        ids, lens = self.vocab.merge(self.vocab.byte[raw[take]], lengths)
        long = lengths > 8
        kept = raw[take[np.repeat(long, lengths)]]
        w, i, b = self.n_words + len(starts), self.n_ids + len(ids), self.n_bytes + len(kept)
        if w > len(self.at):  # one block holds more than the bound
            self.at, self.len, self.size, self.lane, self.byte_at = (np.resize(x, w) for x in (self.at, self.len, self.size, self.lane, self.byte_at))
        if i > len(self.ids):
            self.ids = np.resize(self.ids, i)
        if b > len(self.bytes):
            self.bytes = np.resize(self.bytes, b)
        own = slice(self.n_words, w)
        self.at[own], self.len[own] = self.n_ids + np.cumsum(lens) - lens, lens
        self.ids[self.n_ids : i] = ids
        self.size[own], self.lane[own] = lengths, textkit.lanes(raw, starts, lengths)
        self.bytes[self.n_bytes : b] = kept
        before = np.cumsum(np.where(long, lengths, 0))
        self.byte_at[own] = self.n_bytes + before - np.where(long, lengths, 0)
        numbers = np.arange(self.n_words, w, dtype=np.int32)
        self.n_words, self.n_ids, self.n_bytes = w, i, b
        return numbers

    def _others(self, no: np.ndarray, raw: np.ndarray, s: np.ndarray, size: np.ndarray, lane: np.ndarray) -> np.ndarray:
        """Which pre-tokens do not have the bytes of the one remembered under their number."""
        wrong = (self.size[no] != size) | (self.lane[no] != lane)
        long = np.flatnonzero((size > 8) & ~wrong)
        if len(long):
            each = size[long]
            ends = np.cumsum(each)
            step = np.arange(int(ends[-1])) - np.repeat(ends - each, each)
            differs = raw[step + np.repeat(s[long], each)] != self.bytes[step + np.repeat(self.byte_at[no[long]], each)]
            wrong[long] = np.logical_or.reduceat(differs, ends - each)
        return np.flatnonzero(wrong)

    def _block(self, text: str, offs: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each pre-token in the memory, its length, end of each text in pre-tokens) for texts joined to one."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        begin = split(points, offs)
        width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        byte_at = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=byte_at[1:])
        s = byte_at[begin]
        size = np.diff(s, append=byte_at[-1])
        hashed, lane = textkit.span_hashes(raw, s, size)
        no = self.known.get(hashed)
        miss = no < 0
        if miss.any():
            if self.n_words + int(miss.sum()) > CACHE_WORDS or max(self.n_ids, self.n_bytes) + int(size[miss].sum()) > CACHE_IDS:
                self._forget()
                miss[:] = True
            rows = np.flatnonzero(miss)
            fresh, where = np.unique(hashed[rows], return_index=True)
            rows = rows[where]
            if self.n_words + len(rows) > CACHE_WORDS:
                self.known = Table((self.n_words + len(rows)).bit_length() + 1)
            self.known.put(fresh, self._learn(raw, s[rows], size[rows]))
            no[miss] = self.known.get(hashed[miss])
        # Different pre-tokens of one hash: the second is encoded by itself and not remembered under the hash.
        other = self._others(no, raw, s, size, lane)
        if len(other):
            no[other] = self._learn(raw, s[other], size[other])
        return self.at[no], self.len[no], np.searchsorted(begin, offs[1:])

    def blocks(self, column: pa.Array) -> Iterator[tuple[list[str], list[int]]]:
        """Pieces of texts (special strings apart) with their row, in blocks."""
        texts, rows, held = [], [], 0
        for i, text in enumerate(column.to_pylist()):
            for piece in self._pieces(text or ""):
                texts.append(piece)
                rows.append(i)
                held += len(piece) if isinstance(piece, str) else 1
            if held >= BLOCK_CHARS:
                yield texts, rows
                texts, rows, held = [], [], 0
        if texts:
            yield texts, rows

    def _pieces(self, text: str) -> list:
        pattern = self.vocab.pattern
        if pattern is None or not pattern.search(text):
            return [text] if text else []
        out, last = [], 0
        for m in pattern.finditer(text):
            out += [text[last : m.start()], self.vocab.special[m.group()]]
            last = m.end()
        return [x for x in [*out, text[last:]] if x != ""]

    def _encoded(self, texts: list, want_ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """(tokens of each piece, ids of all pieces one after the other)."""
        plain = [x if isinstance(x, str) else "" for x in texts]
        joined = "".join(plain)
        sizes = np.array([len(x) for x in plain], np.int64)
        counts = np.where(sizes > 0, 0, 1)
        if joined:
            full = np.flatnonzero(sizes)
            offs = np.concatenate([[0], np.cumsum(sizes[full])])
            raw = np.frombuffer(joined.encode("utf-8"), np.uint8)
            at, length, end = self._block(joined, offs, raw)
            run = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
            counts[full] = np.diff(run[np.concatenate([[0], end])])
        if not want_ids:
            return counts, None
        ids = np.empty(int(counts.sum()), np.int32)
        fixed = np.array([isinstance(x, str) for x in texts])
        plain_mask = np.repeat(fixed, counts)
        if joined:
            ends = np.cumsum(length, dtype=np.int64)
            take = np.arange(int(ends[-1])) + np.repeat(at - (ends - length), length)
            ids[plain_mask] = self.ids[take]
        ids[~plain_mask] = [x for x in texts if not isinstance(x, str)]
        return counts, ids

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text of a column (null: 0)."""
        out = np.zeros(len(column), np.int64)
        for texts, rows in self.blocks(column):
            n, _ = self._encoded(texts, False)
            np.add.at(out, rows, n)
        return out

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) of each text of a column in order; texts without tokens are left out."""
        for texts, rows in self.blocks(column):
            n, ids = self._encoded(texts, True)
            owners = np.array(rows)
            cut = np.flatnonzero(np.diff(owners)) + 1
            ends = np.cumsum(n)
            bounds = np.concatenate([[0], ends[cut - 1], ends[-1:]])
            for row, a, b in zip(owners[np.concatenate([[0], cut])], bounds[:-1], bounds[1:], strict=True):
                yield int(row), ids[a:b]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, kept between batches and tasks."""
    return Encoder(path)


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs(doc_id, text)``.

    n_tokens is what the tokenizers library counts without added special tokens (strings of special tokens inside
    a text count as that token, its default).  Null text counts as empty (0, 0, false); a null doc_id stays null; repeated
    rows come out repeatedly; other columns are ignored.  ``path`` must be readable on every worker.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            n = encoder(path).counts(batch.column(1))
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), size, pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
