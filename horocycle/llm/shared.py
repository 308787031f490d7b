"""Shared-storage helpers, joins with a table of unknown size, and distributed connected components.

Everything that must outlive one job (so that a lost executor cannot lose it) is written as Parquet below the
folder that ``spark.checkpoint.dir`` names.  When a local session names none, as in tests, a temporary one is set; on a cluster
that is an error.  Tables written within ``scratch`` are deleted when it ends.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Measured bytes up to which a side is broadcast.
BROADCAST_BYTES = 4 << 20
#: 64-bit words of the bit table that stands in for a larger side: about 4 MB however large that side is.
SIEVE_WORDS = 1 << 17
#: Bytes of an Arrow batch where the session names none: operators work on blocks of at most a megabyte anyway.
BATCH_BYTES = 4 << 20
#: Links that a task contracts at once: 1 MB of numbers.
BLOCK_LINKS = 1 << 16
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_OPEN = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where a local session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="horocycle-")
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it again: lineage is cut and the rows survive lost executors."""
    return _write(df, name, getattr(_OPEN, "paths", None))


def _write(df: DataFrame, name: str, register: list[str] | None) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if register is not None:
        register.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """The tables of one computation; ``kept`` writes the result, which belongs to the scratch around this one, if any."""

    def __init__(self, around: list[str] | None) -> None:
        self.around, self.paths = around, []

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        return _write(df, name, self.around)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Delete at the end, also after an error, what ``written`` wrote within; only tables of ``kept`` may be read later."""
    own = Scratch(getattr(_OPEN, "paths", None))
    _OPEN.paths = own.paths
    try:
        yield own
    finally:
        _OPEN.paths = own.around
        context = spark.sparkContext
        for name in own.paths:
            path = context._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Let no Arrow batch of whole texts exceed BATCH_BYTES, on either side of the pipe; a session's own setting stays."""
    if _BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def row_bytes(schema: T.StructType) -> Column:
    """The bytes of a row of flat columns as Spark holds it, arrays counted as of 8-byte items."""
    total = F.lit(16 + 8 * len(schema)).cast("long")
    for field in schema:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType):
            total = total + 16 + 8 * F.greatest(F.size(field.name), F.lit(0))
    return total


def is_small(table: DataFrame) -> bool:
    """Whether a written table was measured to be within BROADCAST_BYTES."""
    return (table.agg(F.sum(row_bytes(table.schema))).first()[0] or 0) <= BROADCAST_BYTES


def _bits(table: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """(the bit table of the keys of ``table``, the place in it of a row's ``_sieve_hash``)."""
    words = min(SIEVE_WORDS, 1 << max(10, (table.count() // 4).bit_length()))
    place = F.pmod(F.shiftrightunsigned("_sieve_hash", 6), F.lit(words))
    hashed = table.select(F.xxhash64(*keys).alias("_sieve_hash"))
    return hashed.groupBy(place.alias("_sieve_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_sieve_hash & 63 as int)))").alias("_sieve_bits")), place


def possible(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` without most of those that have no partner in ``table`` on ``keys``; nothing is shuffled."""
    bits, place = _bits(table, keys)
    set_there = F.expr("shiftrightunsigned(_sieve_bits, cast(_sieve_hash & 63 as int)) & 1 = 1")
    return rows.withColumn("_sieve_hash", F.xxhash64(*keys)).join(F.broadcast(bits), (place == F.col("_sieve_word")) & set_there).drop("_sieve_hash", "_sieve_word", "_sieve_bits")


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join ``rows``, which may be wide, with the written ``table`` on ``keys``, which both have and which may be null.

    ``how`` is inner, left, left_semi or left_anti; the keys come out once.  A table of bits of the key hashes, bounded in size, is broadcast:
    rows that it shows to be without a partner stay where they are (or go), and only the others are joined exactly.  Where all
    rows come out, a table that was measured to be small is broadcast itself instead.
    """
    inner = {k: f"_sieve_key_{i}" for i, k in enumerate(keys)}
    other = table.withColumnsRenamed(inner)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(inner[k])) for k in keys))
    tidy = lambda df: df.drop(*inner.values())
    small = is_small(table)
    if how in ("inner", "left_semi"):
        return tidy(possible(rows, table, keys).join(F.broadcast(other) if small else other.hint("shuffle_merge"), same, how))
    if small:
        return tidy(rows.join(F.broadcast(other), same, how))
    bits, place = _bits(table, keys)
    marked = rows.withColumn("_sieve_hash", F.xxhash64(*keys)).join(F.broadcast(bits), place == F.col("_sieve_word"), "left")
    maybe = F.expr("coalesce(shiftrightunsigned(_sieve_bits, cast(_sieve_hash & 63 as int)) & 1, 0L) = 1")
    met = tidy(marked.where(maybe).drop("_sieve_hash", "_sieve_word", "_sieve_bits").join(other.hint("shuffle_merge"), same, how))
    rest = marked.where(~maybe).drop("_sieve_hash", "_sieve_word", "_sieve_bits")
    for field in table.schema:
        if how == "left" and field.name not in keys:
            rest = rest.withColumn(field.name, F.lit(None).cast(field.dataType))
    return met.unionByName(rest)


def joined_skewed(rows: DataFrame, table: DataFrame, key: str, often: Column, total: int) -> DataFrame:
    """``rows`` inner ``table`` on ``key``, unique in ``table``, of which ``often`` counts the rows of a key.

    Keys with more than a 10,000th of the ``total`` rows are fewer than 10,000, so their part of the table is broadcast and
    their rows stay spread; the others are shuffled.
    """
    heavy = often > max(1_000, total // 10_000)
    hot, cold = table.where(heavy), table.where(~heavy)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def _stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Each node of the links of one block with the smallest node it reaches by them, itself left out."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        live = low != high
        if not live.any():
            break
        np.minimum.at(root, high[live], low[live])
        while (root[root] != root).any():
            root = root[root]
    moved = root != np.arange(len(ids))
    return pa.RecordBatch.from_arrays([pa.array(ids[moved], pa.int64()), pa.array(ids[root[moved]], pa.int64())], names=["u", "v"])


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each block of BLOCK_LINKS as stars; blocks of any size keep what is connected."""
    us, vs, held = [], [], 0
    for batch in batches:
        us.append(batch.column(0).to_numpy())
        vs.append(batch.column(1).to_numpy())
        held += batch.num_rows
        if held >= BLOCK_LINKS:
            yield _stars(np.concatenate(us), np.concatenate(vs))
            us, vs, held = [], [], 0
    if held:
        yield _stars(np.concatenate(us), np.concatenate(vs))


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(u long, v long)`` as ``(node, comp)``, comp being the smallest node.

    Links are contracted to stars block by block, without a shuffle; where several blocks are left, this alternates with the
    large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond") until all links together
    are stars, which one count per node tells.  Each round is written to shared storage.  Only nodes with a link to another
    node come out.  No step holds the neighbours of a node in one row, so hubs cost only a split join.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = both.join(low, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                low.select("u", F.col("m").alias("v"))
            )
        return out.where("u > v").distinct()

    def contracted(edges: DataFrame, n: int) -> DataFrame:
        return written(edges.coalesce(n // BLOCK_LINKS + 1).mapInArrow(_contract, "u long, v long"), "edges")

    def are_stars(edges: DataFrame) -> bool:
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
        return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 or (ups = 1 and least = 0)").isEmpty()

    edges = contracted(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v"), links.count())
    while not are_stars(edges):
        edges = contracted(star(star(edges, True), False), edges.count())
    comp = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return comp.unionByName(comp.select(F.col("comp").alias("node"), "comp").distinct())
