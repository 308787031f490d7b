"""Extendible hashing of documents into shards of bounded bytes.

A directory is indexed by the leading bits of a hash of the document's id.  A bucket that exceeds the limit splits on the
next bit, and only such a bucket does, so the directory is deep only where it must be.  The splits follow from the bytes below each
hash prefix: these are summed once at a fine depth and once more for each prefix of it, and a prefix is a shard if it
fits while the prefix one bit shorter doesn't.  The directory stays a table.  Where even the finest
prefix is too large, its rows alone go on with the following bits; rows that share a whole hash (one id
again and again) are at last cut in order of their sizes summed up, in steps that leave room for the row across a step's end.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from horocycle.llm import shared

HASH_BITS = 60
#: Bits beyond those that evenly filled shards would need.
SLACK_BITS = 5


def _hash(docs: DataFrame) -> DataFrame:
    """Add ``_h``: the first 60 bits of the id's md5, as a long that no engine computes otherwise."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return docs.withColumn("_h", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))


def _directory(fine: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """``p, depth``: for each prefix ``p`` of ``high`` bits in ``fine(p, bytes)`` the depth, from ``low``, at which its bucket fits.

    Prefixes too large even at ``high`` bits get depth ``high`` + 1.
    """
    steps = F.sequence(F.lit(low), F.lit(high))
    by = fine.select("bytes", F.explode(steps).alias("depth"), "p").withColumn("q", F.expr(f"shiftright(p, {high} - depth)"))
    sums = by.groupBy("depth", "q").agg(F.sum("bytes").alias("bytes"))
    # Along one prefix the sums fall with the depth, so the first depth that fits follows the last that doesn't.
    over = sums.where(F.col("bytes") > limit).select("depth", "q")
    deepest = by.select("depth", "q", "p").join(over, ["depth", "q"]).groupBy("p").agg(F.max("depth").alias("d"))
    return fine.select("p").join(deepest, "p", "left").select("p", (F.coalesce(F.col("d"), F.lit(low - 1)) + 1).alias("depth"))


def shard(docs: DataFrame, limit: int = 256 << 20) -> DataFrame:
    """``doc_id, n_bytes, shard_id, depth`` for every row of ``docs(doc_id, text)``.

    ``shard_id`` is the bucket's hash prefix as bits (empty for a single shard); bytes are those of the UTF-8 text.  Every
    shard's bytes are within ``limit``, but for a single row that alone exceeds it and gets a shard of its own as far as bits
    tell it apart.  Null text has 0 bytes; rows of one id share all bits (a null id counts as one id), so where they
    alone exceed the limit their shard is cut in order and ``.1``, ``.2`` ... is appended.  Other columns are ignored.
    """
    rows = _hash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes")))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    done, low = [], 0
    high = min(HASH_BITS, max(1, math.ceil(math.log2(max(1, total / limit))) + SLACK_BITS))
    rest = rows
    while True:
        prefixed = rest.withColumn("p", F.expr(f"shiftright(_h, {HASH_BITS - high})"))
        with shared.scratch(docs.sparkSession) as held:
            fine = shared.written(prefixed.groupBy("p").agg(F.sum("n_bytes").alias("bytes")), "shard-bytes")
            found = held.kept(_directory(fine, low, high, limit), "directory")
        named = prefixed.join(F.broadcast(found) if shared.is_small(found) else found.hint("shuffle_merge"), "p").drop("p")
        done.append(named.where(F.col("depth") <= high))
        if not found.where(F.col("depth") > high).limit(1).count():
            break
        rest = named.where(F.col("depth") > high).drop("depth")
        if high == HASH_BITS:
            break
        low, high = high + 1, min(HASH_BITS, high + 12)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    bits = F.substring(F.lpad(F.conv(F.col("_h").cast("string"), 10, 2), HASH_BITS, "0"), F.lit(1), F.col("depth"))
    out = out.select("doc_id", "n_bytes", bits.alias("shard_id"), "depth")
    if high == HASH_BITS and found.where(F.col("depth") > high).limit(1).count():
        # Rows over half the limit come last and alone.  The others begin within steps of the limit less the largest of them,
        # so that a part is within the limit with the row that crosses its end.
        hashed = Window.partitionBy("_h")
        ordered = hashed.orderBy("n_bytes").rowsBetween(Window.unboundedPreceding, 0)
        light = F.when(2 * F.col("n_bytes") <= limit, F.col("n_bytes"))
        tail = rest.withColumn("_step", F.lit(limit + 1) - F.max(light).over(hashed)).withColumn("_begin", F.sum(light).over(ordered) - F.col("n_bytes"))
        tail = tail.withColumn("_step_of", F.when(light.isNotNull(), F.expr("_begin div _step")))
        alone = F.sum(F.when(light.isNull(), 1).otherwise(0)).over(ordered)
        tail = tail.withColumn("_part", F.coalesce(F.max("_step_of").over(hashed) + 1, F.lit(0)) + alone)
        tail = tail.withColumn("_part", F.coalesce(F.col("_step_of") + 1, F.col("_part")))
        whole = F.lpad(F.conv(F.col("_h").cast("string"), 10, 2), HASH_BITS, "0")
        tail = tail.select("doc_id", "n_bytes", F.concat_ws(".", whole, F.col("_part").cast("string")).alias("shard_id"), F.lit(HASH_BITS).alias("depth"))
        out = out.unionByName(tail)
    return out
