"""Language identification by error-correcting output codes over character n-grams.

Each language gets a codeword of bits; one binary classifier per bit, on the shares of a text's hashed n-grams, predicts which
side of the bit the text is on.  Decoding adds up, for every language, the loss of each classifier's output against the language's
bit, weighted by how well that classifier did on that language in training; the language of least loss wins, and a text whose
two best are close is flagged.  All classifiers score from one table, so workers get a table of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horocycle.llm import subwords

ORDERS, BUCKETS = (2, 3), 1 << 15
#: Rows of each language that training uses at most (in expectation), and the bytes of the longest one.
SAMPLE_ROWS, SAMPLE_BYTES = 800, 16 << 10
_GAIN = 40.0
UNKNOWN = "und"


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n codewords of bits -1/+1: all distinct splits for up to 6 languages, beyond that well-spread random ones."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6:  # the first language is always on the + side, so no split comes twice
        rest = np.arange(2 ** (n - 1) - 1)
        rows = [np.ones(len(rest), np.int8)] + [np.where(rest >> k & 1, 1, -1).astype(np.int8) for k in range(n - 1)]
        return np.array(rows)
    rng = np.random.default_rng(seed)
    width = max(15, int(np.ceil(10 * np.log2(n))))
    best, apart = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, width))
        if (np.abs(code.sum(0)) == n).any():
            continue
        distance = ((width - code.astype(int) @ code.T) // 2 + width * np.eye(n, dtype=int)).min()
        if distance > apart:
            best, apart = code, distance
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weight: np.ndarray  # languages x bits; rows sum to 1
    table: np.ndarray
    bias: np.ndarray

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the language, -1 for unknown; score; ambiguous) of each text."""
        n = len(column)
        if not self.langs:
            return np.full(n, -1), np.zeros(n), np.ones(n, bool)
        mean, _ = subwords.averages(column, ORDERS, False, self.table)
        loss = self._losses(mean + self.bias)
        best = loss.argmin(1)
        share = np.exp(-(loss - loss.min(1, keepdims=True)) * 4)
        share /= share.sum(1, keepdims=True)
        score = share[np.arange(n), best]
        if len(self.langs) > 1:
            two = np.partition(loss, 1, axis=1)
            ambiguous = two[:, 1] - two[:, 0] < 0.1
        else:
            ambiguous = np.zeros(n, bool)
        letters = np.array([any(map(str.isalpha, t or "")) for t in column.to_pylist()], bool)
        return np.where(letters, best, -1), np.where(letters, score, 0.0), ambiguous | ~letters

    def _losses(self, margin: np.ndarray) -> np.ndarray:
        return np.stack([(self.weight[k] * np.logaddexp(0, -np.clip(margin, -30, 30) * self.code[k])).sum(1) for k in range(len(self.langs))], 1)


def train(texts: list[str], langs: list[str], epochs: int = 6, seed: int = 5) -> Model:
    """Fit one logistic classifier per bit (together, by Adagrad), then weigh them by language."""
    names = sorted(set(langs))
    code = codewords(len(names))
    width = code.shape[1]
    table, bias = np.zeros((BUCKETS, width), np.float32), np.zeros(width, np.float32)
    if not names:
        return Model([], code, np.zeros((0, width)), table, bias)
    of = {x: i for i, x in enumerate(names)}
    y = np.array([of[x] for x in langs])
    bags = subwords.bags(pa.array(texts, pa.string()), ORDERS, False, BUCKETS)
    usable = np.array([i for i, (b, _) in enumerate(bags) if len(b)], np.int64)
    share = np.bincount(y, minlength=len(names))
    even = (len(y) / (len(names) * np.maximum(share, 1)))[y].astype(np.float32)
    table2, bias2 = np.full((BUCKETS, width), 1e-6, np.float32), np.full(width, 1e-6, np.float32)
    rng = np.random.default_rng(seed)
    x = [(c / c.sum() * _GAIN).astype(np.float32) for _, c in bags]
    margin = np.zeros((len(y), width), np.float32)
    for epoch in range(epochs if len(usable) else 0):
        order = rng.permutation(usable)
        rate = 0.5 * (1 - epoch / epochs)
        for lo in range(0, len(order), 16):
            rows = order[lo : lo + 16]
            index = np.concatenate([bags[r][0] for r in rows])
            value = np.concatenate([x[r] for r in rows])
            sizes = np.array([len(bags[r][0]) for r in rows])
            out = np.add.reduceat(table[index] * value[:, None], np.cumsum(sizes) - sizes) + bias
            margin[rows] = out
            target = code[y[rows]]
            grad = -target / (1 + np.exp(np.clip(out * target, -30, 30))) * even[rows, None] / len(rows)
            unique, inverse = np.unique(index, return_inverse=True)
            each = np.repeat(grad, sizes, axis=0) * value[:, None]
            change = np.stack([np.bincount(inverse, weights=each[:, k], minlength=len(unique)) for k in range(width)], 1).astype(np.float32)
            table2[unique] += change**2
            table[unique] -= rate * change / np.sqrt(table2[unique])
            total = grad.sum(0)
            bias2 += total**2
            bias -= 0.1 * rate * total / np.sqrt(bias2)
    right = (np.sign(margin) == code[y]) * 1.0
    weight = np.stack([right[y == k].mean(0) if (y == k).any() else np.ones(width) for k in range(len(names))]) + 1e-6
    return Model(names, code, weight / weight.sum(1, keepdims=True), table * np.float32(_GAIN), bias)


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[str], list[str]]:
    """(texts, languages) of about ``rows`` learnable rows of each language, chosen by a hash of the id."""
    learn = docs.where("doc_id is not null and lang is not null and text is not null").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    learn = learn.where(F.octet_length("text") <= SAMPLE_BYTES)
    sizes = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().collect()}
    if not sizes:
        return [], []
    keep = reduce(lambda a, b: a | b, ((F.col("lang") == v) & (F.pmod(F.xxhash64("doc_id"), F.lit(n)) < rows) for v, n in sizes.items()))
    got = sorted((r["doc_id"], r["lang"], r["text"]) for r in learn.where(keep).select("doc_id", "lang", "text").toLocalIterator())
    return [x[2] for x in got], [x[1] for x in got]


def predict_languages(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` for every row of ``docs(doc_id, text, lang)``.

    Learns from text and non-null lang of rows whose crc32(doc_id as text) mod 4 is not 2: about ``rows`` per language, of
    texts of up to SAMPLE_BYTES; predicts from whole texts alone.  Text that is null or has no letter gives ``und``
    with score 0, as does every text if nothing can be learned.  A null doc_id is neither held out nor learned from;
    repeated rows come out repeatedly.  Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(*sample(docs, rows))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score, ambiguous = model.predict(batch.column(2))
            names = pa.array([model.langs[k] if k >= 0 else UNKNOWN for k in best], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), names, pa.array(score, pa.float64()), pa.array(ambiguous)],
                names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    schema = "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean"
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, schema)
