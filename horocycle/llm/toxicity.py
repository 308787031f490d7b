"""Toxicity scores: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is the bag of its words' character n-grams and of the words themselves, hashed to buckets.  Every bucket
has an embedding; their average goes through a linear softmax of two classes, and the gradient flows into both.  A misspelt
toxic word shares most n-grams with the word, so it is near it without having been seen.  Because all is linear up
to the softmax, scoring needs one number per bucket, and workers get a table of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horocycle.llm import subwords

ORDERS, BUCKETS, DIM = (3, 4, 5), 1 << 18, 4
#: Labelled rows of each class that training uses at most (in expectation), and the bytes of the longest one.
SAMPLE_ROWS, SAMPLE_BYTES = 5_000, 16 << 10
#: Texts of the sample that an n-gram must occur in to count.
LEAST_TEXTS = 4
_GAIN = 40.0


@dataclass
class Model:
    """log-odds of a text = mean over its n-grams of ``table`` + ``bias``."""

    table: np.ndarray
    bias: float
    orders: tuple[int, ...] = ORDERS

    def scores(self, column: pa.Array) -> np.ndarray:
        mean, _ = subwords.averages(column, self.orders, True, self.table[:, None])
        return 1 / (1 + np.exp(-np.clip(mean[:, 0] + self.bias, -60, 60)))


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray, epochs: int = 5, seed: int = 7) -> Model:
    """Joint training by Adagrad over mini-batches; ``weights`` are those of the rows in the loss."""
    rng = np.random.default_rng(seed)
    bags = subwords.bags(pa.array(texts, pa.string()), ORDERS, True, BUCKETS)
    # n-grams of few texts would be learnt by heart; they stay in the average, but say nothing.
    spread = np.zeros(BUCKETS, np.int64)
    for b, _ in bags:
        spread[b] += 1
    common = spread >= LEAST_TEXTS
    totals = np.array([c.sum() for _, c in bags], np.float32)
    for i, (b, c) in enumerate(bags):  # in place: the driver holds the sample once
        keep = common[b]
        bags[i] = (b[keep], c[keep])
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, 2), np.float32)
    bias = np.zeros(2, np.float32)
    embed2, out2, bias2 = np.full(BUCKETS, 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    out[:, 1], out[:, 0] = rng.normal(0, 0.5, DIM), 0
    out[:, 0] = -out[:, 1]
    usable = np.array([i for i, (b, _) in enumerate(bags) if len(b)], np.int64)
    for epoch in range(epochs if len(usable) else 0):
        rate = 0.3 * (1 - epoch / epochs)
        order = rng.permutation(usable)
        for lo in range(0, len(order), 32):
            rows = order[lo : lo + 32]
            index = np.concatenate([bags[r][0] for r in rows])
            counts = np.concatenate([bags[r][1] for r in rows]).astype(np.float32)
            sizes = np.array([len(bags[r][0]) for r in rows])
            starts = np.cumsum(sizes) - sizes
            share = counts / np.repeat(totals[rows], sizes) * _GAIN
            hidden = np.add.reduceat(embed[index] * share[:, None], starts)
            logits = hidden @ out + bias
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            grad = p * weights[rows, None] / len(rows)
            grad_hidden = grad @ out.T
            grad_out, grad_bias = hidden.T @ grad, grad.sum(0)
            unique, inverse = np.unique(index, return_inverse=True)
            rows_grad = np.zeros((len(unique), DIM), np.float32)
            each = np.repeat(grad_hidden, sizes, axis=0) * share[:, None]
            for k in range(DIM):
                rows_grad[:, k] = np.bincount(inverse, weights=each[:, k], minlength=len(unique))
            embed2[unique] += (rows_grad**2).mean(1)
            embed[unique] -= rate * rows_grad / np.sqrt(embed2[unique])[:, None]
            out2 += grad_out**2
            out -= 0.1 * rate * grad_out / np.sqrt(out2)
            bias2 += grad_bias**2
            bias -= 0.1 * rate * grad_bias / np.sqrt(bias2)
    table = (embed @ (out[:, 1] - out[:, 0]) * _GAIN).astype(np.float32)
    table[~common] = 0  # else they would speak by their random beginnings
    return Model(table, float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(texts, labels, weights) of learnable rows: about ``rows`` of each class, weighted back to their true shares."""
    learn = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    learn = learn.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    sizes = {r["toxic"]: r["count"] for r in learn.groupBy("toxic").count().collect()}
    keep = F.lit(False)
    for value, n in sizes.items():
        keep = keep | ((F.col("toxic") == value) & (F.pmod(F.xxhash64("doc_id"), F.lit(n)) < rows))
    picked = F.broadcast(learn.where(keep))
    found = docs.select("doc_id", "text").where(F.octet_length("text") <= SAMPLE_BYTES).join(picked, "doc_id").select("doc_id", "text", "toxic")
    got = sorted((r["doc_id"], r["toxic"], r["text"]) for r in found.toLocalIterator())
    y = np.array([x[1] for x in got], np.int64)
    total = sum(sizes.values())
    weight = {v: (n / total) / max(1e-9, (y == v).mean() if len(y) else 1) for v, n in sizes.items()}
    return [x[2] for x in got], y, np.array([weight[v] for v in y], np.float32)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``.

    The model learns from ``labels(doc_id, toxic)`` of rows whose crc32(doc_id as text) mod 4 is not 2, from about ``rows`` of
    each class (chosen by a hash of the id, texts of up to SAMPLE_BYTES); scores use whole texts and nothing but
    texts.  Null and empty texts score as a text without words; a null doc_id is not held out and not learned from;
    repeated rows come out repeatedly; rows with several labels count as toxic if one says so; without labels every
    score is 0.5.  Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = train(*sample(docs, labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")), rows))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.scores(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
