"""Benchmark decontamination: MinHash containment search for short items inside long documents.

A document that holds an item contains almost all of the item's shingles and much else besides, so the Jaccard similarity of the
two is near zero and sketches of whole documents lose the item.  Therefore the *items* are sketched.  Items are
partitioned by size (powers of two of their shingle count), each partition with its own sketch length, and an item's
MinHash sketch holds its smallest shingle hashes.  An item of n shingles that is contained to at least ``percent`` misses at most
n - ceil(percent n / 100) of them, so a sketch of one more than that meets every document that contains the item: the search has
no false negatives.  A partition uses the length that its largest item asks for.  Documents probe the
sketches with all shingles of their whole text, and what is found is verified by exact shingle containment.

Benchmarks go to the executors in blocks of a bounded number of shingles, each of which is held against all
documents; documents are never shuffled and never leave their partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horocycle.llm import shared, textkit

#: UTF-8 bytes of benchmark text in one block: about 40 MB of hashes on a worker at most.
BLOCK_BENCHMARK_BYTES = 16 << 20


def needed(n: int, percent: int) -> int:
    return max(1, -(-percent * n // 100))


class ItemIndex:
    """Sketches and full shingle sets of a block of items as sorted arrays."""

    def __init__(self, ids: list[int | None], texts: list[str | None], words: int, percent: int) -> None:
        self.words, self.ids = words, ids
        sets = list(textkit.shingle_sets(pa.array(texts, pa.string()), words))
        self.size = np.array([len(x) for x in sets], np.int64)
        self.least = np.array([needed(len(x), percent) for x in sets], np.int64)
        partition = np.array([len(x).bit_length() for x in sets], np.int64)
        missing = self.size - self.least
        sketch = [
            x[: 1 + int(missing[partition == p].max())]  # sorted hashes: the first are the minima
            for x, p in zip(sets, partition, strict=True)
        ]
        self.probe = np.unique(np.concatenate(sketch)) if sketch else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.size)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]

    def search(self, tokens: np.ndarray) -> list[tuple[int, int]]:
        """(item number, shingles found) for items that the sorted distinct ``tokens`` contain."""
        if not len(self.probe) or not len(tokens):
            return []
        at = np.searchsorted(self.probe, tokens)
        if not (self.probe[np.minimum(at, len(self.probe) - 1)] == tokens).any():
            return []
        a, b = np.searchsorted(self.flat, tokens, "left"), np.searchsorted(self.flat, tokens, "right")
        hits = b - a
        a, hits = a[hits > 0], hits[hits > 0]
        ends = np.cumsum(hits)
        found = np.bincount(self.owner[np.arange(int(ends[-1])) + np.repeat(a - (ends - hits), hits)], minlength=len(self.size))
        return [(int(i), int(found[i])) for i in np.flatnonzero((found >= self.least) & (self.size > 0))]


def _search(index: ItemIndex):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, items, found = [], [], []
            for i, tokens in enumerate(textkit.shingle_sets(batch.column(1), index.words)):
                for item, n in index.search(tokens):
                    rows.append(i)
                    items.append(item)
                    found.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([index.ids[x] for x in items], pa.int64()), pa.array([int(index.size[x]) for x in items], pa.int64()), pa.array(found, pa.int64())],
                names=["doc_id", "item_id", "n_shingles", "n_found"],
            )

    return run


def _blocks(items: DataFrame) -> Iterator[tuple[list, list]]:
    """The benchmark in blocks of bounded bytes, one on the driver at a time."""
    ids, texts, held = [], [], 0
    for row in items.toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        held += len(row[1] or "")
        if held >= BLOCK_BENCHMARK_BYTES // 4:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def find_items(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_found`` for each document that contains an item to at least ``percent`` of its shingles.

    ``docs(doc_id, text)`` and ``items(item_id, text)`` are split into lower-cased words (A-Z); an item with fewer than
    ``words`` words is its whole sequence and is found only in documents of that sequence.  Items and documents that are null or
    blank are found nowhere.  Repeated rows on either side come out repeatedly; a null id stays null.  An empty
    benchmark gives no rows.  Other columns are ignored.
    """
    shared.bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, n_shingles long, n_found long"
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    parts = [docs.mapInArrow(_search(ItemIndex(ids, texts, words, percent)), schema) for ids, texts in _blocks(items)]
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)


def without_items(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns and in the same partitions."""
    shared.bounded_batches(docs.sparkSession)
    schema = docs.schema
    names = docs.columns
    at = names.index("text")
    out = docs
    for ids, texts in _blocks(items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))):
        index = ItemIndex(ids, texts, words, percent)

        def clean(batches: Iterable[pa.RecordBatch], index: ItemIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = [not index.search(tokens) for tokens in textkit.shingle_sets(batch.column(at), index.words)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        out = out.mapInArrow(clean, schema)
    return out
