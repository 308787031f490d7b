"""Sequence and lineage functions: k-mers, windows, encoders, tokens, and names of taxa."""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from horocycle.functions import numeric as N
from horocycle.functions.geometry import let
from horocycle.functions.groups import map_groups
from horocycle.functions.constants import KAPPA, MIN_WINDOW, RANKS, STRIDE, WINDOW

MAX_TOKENS = 512


def clean_dna(seq: Column) -> Column:
    """Upper case with N read as A."""
    return F.replace(F.upper(seq), F.lit("N"), F.lit("A"))


def kmers(seq: Column, k: int = 4) -> Column:
    """All k-mers of A, C, G and T, in order."""

    def of(s: Column) -> Column:
        # Characters are addressed in an array: substrings of a long string would be sought from its start each time.
        every = let(F.split(s, ""), lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - k), lambda i: F.concat(*(F.get(c, i + j) for j in range(k)))))
        valid = F.when(s.rlike("^[ACGT]*$"), every).otherwise(F.filter(every, lambda x: x.rlike("^[ACGT]+$")))
        return F.when(F.length(s) >= k, valid).otherwise(F.array().cast("array<string>"))

    return let(clean_dna(seq), of)


def kmer_index(kmer: Column, k: int = 4) -> Column:
    """The k-mer as a number in base 4: A 0, C 1, G 2, T 3."""
    out = F.lit(0)
    for i in range(k):
        out = out * 4 + F.instr(F.lit("ACGT"), F.substring(kmer, F.lit(i + 1), F.lit(1))) - 1
    return out


#: Letters that are counted at once, and the longest k-mers that are counted in a row of all of them.
_LETTERS, DENSE = 1 << 20, 6


def kmer_counts(seqs: list[str | None], k: int) -> np.ndarray:
    """A row of counts of all 4**k k-mers for each sequence, in order of their numbers; what holds another letter is no k-mer."""
    code = np.full(256, 255, np.uint8)
    code[[ord(c) for c in "ACGTN"]] = [0, 1, 2, 3, 0]
    out = np.zeros((len(seqs), 4**k), np.int64)
    texts = [(s or "").upper().encode("latin-1", "replace") for s in seqs]
    lo = 0
    while lo < len(texts):
        hi, size = lo + 1, len(texts[lo])
        while hi < min(len(texts), lo + 1000) and size + len(texts[hi]) <= _LETTERS:
            size += len(texts[hi])
            hi += 1
        x = code[np.frombuffer(b"\0".join(texts[lo:hi]), np.uint8)]
        if (n := len(x) - k + 1) > 0:
            bad, value = np.zeros(n, bool), np.repeat(np.arange(hi - lo, dtype=np.int32), [len(t) + 1 for t in texts[lo:hi]])[:n]
            for j in range(k):
                bad |= x[j : j + n] == 255
                value = value * 4 + x[j : j + n]
            out[lo:hi] = np.bincount(value[~bad], minlength=(hi - lo) * 4**k)[: (hi - lo) * 4**k].reshape(hi - lo, -1)
        lo = hi
    return out


def kmer_histogram(sequences: DataFrame, k: int = 4) -> DataFrame:
    """``sequence_id, kmer, n, freq`` of ``sequences(sequence_id, sequence)``: counts and their shares.

    Rows are counted where they are, and rows of counts meet by id; k-mers above ``DENSE`` letters are listed and grouped.
    """
    if k > DENSE:
        rows = sequences.select("sequence_id", F.explode(kmers(F.col("sequence"), k)).alias("kmer")).groupBy("sequence_id", "kmer").agg(F.count("*").alias("n"))
        total = rows.groupBy("sequence_id").agg(F.sum("n").alias("_t"))
        return rows.join(total, "sequence_id").select("sequence_id", "kmer", "n", (F.col("n") / F.col("_t")).alias("freq"))
    kind = dict(sequences.dtypes)["sequence_id"]
    names = pa.array(["".join(x) for x in itertools.product("ACGT", repeat=k)])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                found = kmer_counts(batch.column(1).slice(lo, 1000).to_pylist(), k)
                some = np.flatnonzero(found.any(1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 1000).take(pa.array(some)), pa.array([x.tobytes() for x in found[some].astype(np.int32)], pa.binary())], names=["sequence_id", "counts"])

    def merge(table: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, counts, ends = table.column(0).combine_chunks(), table.column(1).to_pylist(), [*first[1:], table.num_rows]
        for lo in range(0, len(first), 1000):
            at = first[lo : lo + 1000]
            rows = np.frombuffer(b"".join(counts[at[0] : ends[min(lo + 1000, len(first)) - 1]]), np.int32).reshape(-1, 4**k).astype(np.int64)
            n = np.add.reduceat(rows, at - at[0])
            row, code = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at[row])), names.take(pa.array(code)), pa.array(n[row, code]), pa.array(n[row, code] / n.sum(1)[row])], names=["sequence_id", "kmer", "n", "freq"])

    rows = sequences.select("sequence_id", "sequence").mapInArrow(count, f"sequence_id {kind}, counts binary")
    return map_groups(rows, ["sequence_id"], merge, f"sequence_id {kind}, kmer string, n bigint, freq double")


def windows(seq: Column, size: int = WINDOW, stride: int = STRIDE, least: int = MIN_WINDOW) -> Column:
    """Windows of a sequence with a last one flush with its end; one that is shorter than a window is its own, if not too short."""
    return let(seq, lambda s: _windows(s, size, stride, least))


def _windows(seq: Column, size: int, stride: int, least: int) -> Column:
    n = F.length(seq)
    full = F.transform(F.sequence(F.lit(1), n - size + 1, F.lit(stride)), lambda i: F.substring(seq, i, F.lit(size)))
    tail = F.when((n - size) % stride != 0, F.array(F.substring(seq, n - size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    short = F.when(n >= least, F.array(seq)).otherwise(F.array().cast("array<string>"))
    return F.when(n >= size, F.concat(full, tail)).otherwise(short)


def default_projection(k: int = 4, dim: int = 64, seed: int = 42) -> np.ndarray:
    """A random projection of k-mer shares with unit columns."""
    p = np.random.default_rng(seed).standard_normal((4**k, dim))
    return p / np.linalg.norm(p, axis=0, keepdims=True)


class KmerEncoder:
    """Any object with ``encode_batch(list of sequences) -> (n, dim)`` can stand in for this one."""

    def __init__(self, k: int = 4, projection: np.ndarray | None = None, kappa: float = KAPPA) -> None:
        self.k, self.kappa = k, kappa
        self.projection = default_projection(k) if projection is None else projection

    def counts(self, seq: str) -> np.ndarray:
        if self.k <= DENSE:
            return kmer_counts([seq], self.k)[0].astype(float)
        code = np.full(256, -1, np.int64)
        code[[ord(c) for c in "ACGTN"]] = [0, 1, 2, 3, 0]
        x = code[np.frombuffer(seq.upper().encode("latin-1", "replace"), np.uint8)]
        if len(x) < self.k:
            return np.zeros(4**self.k)
        view = np.lib.stride_tricks.sliding_window_view(x, self.k)
        good = view[(view >= 0).all(1)]
        return np.bincount(good @ (4 ** np.arange(self.k - 1, -1, -1)), minlength=4**self.k).astype(float)

    def encode_batch(self, seqs: list[str]) -> np.ndarray:
        freq = kmer_counts(seqs, self.k).astype(float) if self.k <= DENSE else np.stack([self.counts(s or "") for s in seqs])
        total = freq.sum(1, keepdims=True)
        z = np.divide(freq, total, out=np.zeros_like(freq), where=total > 0) @ self.projection
        norm = np.linalg.norm(z, axis=1, keepdims=True)
        z = np.divide(z, norm, out=np.zeros_like(z), where=norm > 0) * 0.7 / math.sqrt(self.kappa)
        return N.clamp(z, self.kappa)


def encoded(sequences: DataFrame, encoder=None, col: str = "sequence", keep: bool = True) -> DataFrame:
    """Add ``embedding`` by an encoder object, in Arrow batches; works on streams too.  Without ``keep`` the texts are left out."""
    encoder = encoder or KmerEncoder()
    at = sequences.columns.index(col)
    left = [i for i in range(len(sequences.columns)) if keep or i != at]
    schema = T.StructType([*(sequences.schema.fields[i] for i in left), T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z = np.asarray(encoder.encode_batch(batch.column(at).to_pylist()), float)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in left), lists], names=schema.names)

    return sequences.mapInArrow(run, schema)


class Vocabulary:
    """Tokens of a greedy longest-match tokeniser: a list, {"vocab": [...]} or token to id."""

    def __init__(self, data) -> None:
        data = data.get("vocab", data) if isinstance(data, dict) and isinstance(data.get("vocab"), (list, dict)) else data
        self.ids = {t: i for i, t in enumerate(data)} if isinstance(data, list) else dict(data)
        self.unknown = self.ids.get("[UNK]", self.ids.get("<UNK>", 1))
        self.pad = self.ids.get("[PAD]", self.ids.get("<PAD>", 0))
        self.longest = max(map(len, self.ids), default=1)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path) as f:
            return cls(json.load(f))

    def encode(self, seq: str, max_length: int = MAX_TOKENS) -> list[int]:
        seq = (seq or "").upper().replace("N", "A")
        out, i = [], 0
        while i < len(seq) and len(out) < max_length:
            for size in range(min(self.longest, len(seq) - i), 0, -1):
                if (token := self.ids.get(seq[i : i + size])) is not None:
                    out.append(token)
                    i += size
                    break
            else:
                out.append(self.unknown)
                i += 1
        return out + [self.pad] * (max_length - len(out))


def tokens(sequences: DataFrame, vocabulary: Vocabulary, max_length: int = MAX_TOKENS) -> DataFrame:
    """Add ``tokens`` of fixed length."""
    at = sequences.columns.index("sequence")
    schema = T.StructType([*sequences.schema.fields, T.StructField("tokens", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [vocabulary.encode(s, max_length) for s in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.int32()))], names=[*batch.schema.names, "tokens"])

    return sequences.mapInArrow(run, schema)


def padded(tokens: Column, n: int) -> Column:
    """Cut to ``n`` or filled up with zeros."""
    return F.slice(F.concat(tokens, F.array_repeat(F.lit(0), n)), 1, n)


def clean_label(x: Column) -> Column:
    """Trimmed, spaces to underscores, UNK where empty."""
    return F.replace(F.trim(F.coalesce(F.when(x != "", x), F.lit("UNK"))), F.lit(" "), F.lit("_"))


def lineage(levels: list[Column]) -> Column:
    """Seven prefixed ids; below the domain each names the domain too, so that equal names in two domains stay apart."""
    names = [clean_label(x) for x in levels]
    return F.array(F.concat(F.lit(RANKS[0].prefix), names[0]), *(F.concat(F.lit(r.prefix), names[0], F.lit("|"), x) for r, x in zip(RANKS[1:], names[1:], strict=True)))


def domain_of(lineage: Column, taxon: Column) -> Column:
    """The first domain whose name occurs in the lineage or the taxon."""
    text = F.concat_ws(";", lineage, taxon)
    out = F.lit(None).cast("string")
    for name in ("Viruses", "Eukaryota", "Archaea", "Bacteria"):
        out = F.when(F.contains(text, F.lit(name)), name).otherwise(out)
    return out


def rank_from_lineage(text: Column) -> Column:
    """The rank of a ;-separated lineage by its parts; -1 if empty."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, -1).otherwise(F.least(F.size(F.split(text, ";")) - 1, F.lit(6)))


def row_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))
