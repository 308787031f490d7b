"""Exact set-similarity self-join of documents on word shingles with a token-group matrix.

Steps, none of which gathers a group of unbounded size in one task or on the driver:

1. One scan turns each text into the set of its shingle hashes and keeps a digest of the set (128 bits; 64 of them name the set
   but where two sets share these).  Texts with equal sets form a class; from here on a class counts once, so copies cost nothing.  The
   same scan counts, block by block over all documents, shingles that several different sets of a block share; the most shared
   ones (a bounded number) come last in the global token order.  The order has no influence on the result, only on the work.
2. A second scan emits the prefix of each set in that order.  Two sets that reach the similarity share a token
   of their prefixes, so tokens of one set only are dropped at once.
3. Similar sets are partitioned into groups by the most shared token of their prefix (a family); a family of many tokens is split
   by hash into groups of bounded weight.  The token-group matrix has one row per (token, group).
4. A split family would ask for all pairs of its groups.  So each of its groups is first opened by itself and against one pivot group;
   what that links is a cluster, whose sets need not meet again.  The cluster then stands in the matrix as one.
5. Two entries of the matrix are paired if their sizes allow the similarity and their unions of prefix tokens share as many tokens as
   any pair of their sets must.  When a pair of groups is opened, each query set is first bounded by its overlap with the union of
   the other group's tokens; only sets that pass are counted exactly.  A pair of groups emits a spanning forest of its links, never all pairs.
6. Connected components over the links give each document the smallest reachable doc_id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from horocycle.llm import shared, textkit

#: Tokens of the shared ones that come last in the order: 1 MB on each worker, whatever the input.
HOT_TOKENS = 1 << 17
#: Summed set sizes to which a group is split.
GROUP_TOKENS = 1 << 16
_FLUSH = 1 << 21
_SALTS = 64


def needed(n: int, percent: int) -> int:
    """The least intersection of a set of size n with any set at the similarity."""
    return -(-percent * n // 100)


def demanded(n: int) -> int:
    """Prefix tokens that two sets at the similarity share at least, for the smaller one's size (see ``_prefixes``)."""
    return 1 + n // 20


def _digests(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two numbers."""
    low = np.add.reduce(textkit.mix(tokens), dtype=np.uint64, keepdims=True)
    high = np.bitwise_xor.reduce(textkit.mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), keepdims=True)
    first = textkit.mix(low ^ (high * np.uint64(0x9E3779B97F4A7C15)))
    second = textkit.mix(low * np.uint64(0xC2B2AE3D27D4EB4F) + textkit.mix(high))
    return int(textkit.signed(first)[0]), int(textkit.signed(second)[0])


def _name(tokens: np.ndarray, twins: frozenset[int]) -> int:
    """The number that stands for a set: the first 64 bits, or the others where ``twins`` says that different sets share the first."""
    first, second = _digests(tokens)
    return second if first in twins else first


class _Seen:
    """Digests met before in this task; forgets all when full, which costs repeated rows but no result."""

    def __init__(self, most: int = 1 << 18) -> None:
        self.most, self.keys = most, set()

    def first(self, key: object) -> bool:
        if key in self.keys:
            return False
        if len(self.keys) >= self.most:
            self.keys.clear()
        self.keys.add(key)
        return True


def _scan(words: int, least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, weight = _Seen(), [], 0

        def counted() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            hot = n >= least
            return pa.RecordBatch.from_arrays(
                [*(pa.nulls(int(hot.sum()), pa.int64()) for _ in "it"), pa.array(n[hot], pa.int64()), pa.array(textkit.signed(tokens[hot]), pa.int64()), pa.nulls(int(hot.sum()), pa.int64()), pa.array(np.ones(int(hot.sum()), bool))],
                names=["doc_id", "t", "n", "k", "second", "hot"],
            )

        for batch in batches:
            sizes, keys, seconds = [], [], []
            for tokens in textkit.shingle_sets(batch.column(1), words):
                n = len(tokens)
                key, second = _digests(tokens) if n else (0, 0)
                sizes.append(n)
                keys.append(key)
                seconds.append(second)
                if n and seen.first((key, second)):
                    held.append(tokens)
                    weight += n
                    if weight >= _FLUSH:
                        yield counted()
                        held, weight = [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(seconds, pa.int64()), pa.array(np.zeros(len(sizes), bool))],
                names=["doc_id", "t", "n", "k", "second", "hot"],
            )
        if held:
            yield counted()

    return run


def _prefixes(words: int, percent: int, hot: np.ndarray, twins: frozenset[int]):
    """The first tokens of each set in the global order.

    Sets at the similarity share at least needed(n) tokens of a set of n, so all but needed(n) - k of them lie in its first
    n - needed(n) + k tokens.  The first min(k, k') shared tokens in the global order therefore lie in both prefixes.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            tokens_out, keys, sizes, flags = [], [], [], []
            for tokens in textkit.shingle_sets(batch.column(1), words):
                n = len(tokens)
                if not n or not seen.first(key := _name(tokens, twins)):
                    continue
                at = np.searchsorted(hot, tokens)
                late = hot[np.minimum(at, len(hot) - 1)] == tokens if len(hot) else np.zeros(n, bool)
                take = min(n, n - needed(n, percent) + demanded(n))
                rare = tokens[~late][:take]
                common = tokens[late][: take - len(rare)]
                tokens_out += [rare, common]
                flags += [np.zeros(len(rare), bool), np.ones(len(common), bool)]
                keys.append(np.full(take, key, np.int64))
                sizes.append(np.full(take, n, np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(textkit.signed(np.concatenate(tokens_out)), pa.int64()), pa.array(np.concatenate(keys), pa.int64()), pa.array(np.concatenate(sizes), pa.int32()), pa.array(np.concatenate(flags))],
                    names=["token", "k", "n", "hot"],
                )

    return run


def _sets(words: int, twins: frozenset[int]):
    """Token sets for ``(k, unit, side, text)``; rows of one text follow one another, so its set is made once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, last, tokens = _Seen(), None, np.zeros(0, np.uint64)
        for batch in batches:
            want = batch.column(0).to_pylist()
            unit = batch.column(1).to_pylist()
            keep, lists, weight = [], [], 0

            def made(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                index = pa.array(keep, pa.int64())
                ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
                columns = [batch.column(1).take(index), batch.column(2).take(index), batch.column(0).take(index)]
                return pa.RecordBatch.from_arrays(
                    [*columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["unit", "side", "k", "tokens"]
                )

            for i, k in enumerate(want):
                if k != last:
                    tokens = next(textkit.shingle_sets(batch.column(3).slice(i, 1), words))
                    last = k
                # The same row again; or, where two texts of one id share a digest, the other text.
                if not len(tokens) or _name(tokens, twins) != k:
                    last = None
                    continue
                if not seen.first((k, unit[i])):
                    continue
                keep.append(i)
                lists.append(textkit.signed(tokens))
                weight += len(tokens)
                if weight > 1 << 20:
                    yield made()
                    keep, lists, weight = [], [], 0
            yield made()

    return run


class _Forest:
    """Union-find over the members of one opened pair of groups."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def open_pair(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest between two groups of sorted token sets, or within one (``right`` None).

    Members are numbered left first, then right.
    """
    within = right is None
    other = left if within else right
    base = 0 if within else len(left)
    forest = _Forest(len(left) + (0 if within else len(right)))
    flat = np.concatenate(other)
    owner = np.repeat(np.arange(len(other)), [len(x) for x in other])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    size = np.array([len(x) for x in other], np.int64)
    for i, query in enumerate(left):
        a, b = np.searchsorted(flat, query, "left"), np.searchsorted(flat, query, "right")
        hits = b - a
        least = max(needed(len(query), percent), needed(int(size.min()), percent))
        if int((hits > 0).sum()) < least:  # the bound by the group's union: nothing in it can reach the similarity
            continue
        a, hits = a[hits > 0], hits[hits > 0]
        ends = np.cumsum(hits)
        at = np.arange(int(ends[-1])) + np.repeat(a - (ends - hits), hits)
        shared_tokens = np.bincount(owner[at], minlength=len(other))
        linked = 100 * shared_tokens >= percent * (len(query) + size - shared_tokens)
        for j in np.flatnonzero(linked):
            if (not within or j > i) and forest.join(i, base + int(j)):
                yield i, base + int(j)


def _open(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, left, right, names_l, names_r, out = None, [], [], [], [], []

        def close() -> None:
            if left and (right or len(left) > 1):
                names = names_l + names_r
                out.extend((names[i], names[j]) for i, j in open_pair(left, right or None, percent))

        def batch_out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["u", "v"])
            out.clear()
            return made

        for batch in batches:
            units, sides, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2))
            lists = batch.column(3)
            flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            offs = lists.offsets.to_numpy()
            for x in range(len(units)):
                if unit is None or units[x] != unit:
                    close()
                    unit, left, right, names_l, names_r = units[x], [], [], [], []
                tokens = flat[offs[x] : offs[x + 1]].copy()
                (right if sides[x] else left).append(tokens)
                (names_r if sides[x] else names_l).append(int(keys[x]))
            if len(out) >= 10_000:
                yield batch_out()
        close()
        yield batch_out()

    return run


def _links(docs: DataFrame, groups: DataFrame, units: DataFrame, classes: DataFrame, words: int, percent: int, twins: frozenset[int]) -> DataFrame:
    """``u, v``: spanning forests of the links in each of ``units(ga, gb)``, pairs of ``groups(k, gid)`` or one and the same."""
    spark = docs.sparkSession
    units = shared.written(units.select("ga", "gb", F.xxhash64("ga", "gb").alias("unit")), "units")
    if units.isEmpty():
        return spark.createDataFrame([], "u long, v long")
    sides = units.select("unit", F.col("ga").alias("gid"), F.lit(False).alias("side")).unionByName(
        units.where("ga <> gb").select("unit", F.col("gb").alias("gid"), F.lit(True).alias("side"))
    )
    wanted = groups.select("k", "gid").join(sides, "gid").join(classes.select("k", "at"), "k").select("at.doc_id", "at.t", "k", "unit", "side")
    wanted = shared.written(wanted, "wanted")
    texts = shared.looked_up(docs, wanted, ["doc_id", "t"], "inner").select("k", "unit", "side", "text")
    work = texts.mapInArrow(_sets(words, twins), "unit long, side boolean, k long, tokens array<long>")
    work = work.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "unit").sortWithinPartitions("unit")
    return shared.written(work.mapInArrow(_open(percent), "u long, v long"), "links")


def _most_shared(counted: DataFrame) -> np.ndarray:
    """At most HOT_TOKENS tokens of ``counted(token, df)``, the most shared ones, sorted; no task gathers more than comes out."""
    step = F.floor(F.log2("df") * 8).cast("int")
    sizes = sorted(((r["step"], r["count"]) for r in counted.groupBy(step.alias("step")).count().collect()), reverse=True)
    held, least = 0, None
    for at, n in sizes:
        if held + n > HOT_TOKENS:
            break
        held, least = held + n, at
    found = counted.where(step >= least).select("token").collect() if held else []
    return np.sort(np.array([x.token for x in found], np.int64).view(np.uint64))


def _clusters(docs: DataFrame, groups: DataFrame, classes: DataFrame, words: int, percent: int, twins: frozenset[int]) -> tuple[DataFrame, DataFrame]:
    """(``groups`` with what split families link as clusters, the links found).

    Every group of a split family is opened by itself and against the first group of its size class and of the one below.
    """
    own = groups.where("parts > 1").groupBy("m", "size", "gid").agg(F.min("part").alias("part"), F.count("*").alias("members"))
    own = shared.written(own, "split-groups")
    pivots = own.groupBy("m", "size").agg(F.min_by("gid", "part").alias("ga"))
    below = pivots.unionByName(pivots.select("m", (F.col("size") + 1).alias("size"), "ga"))
    units = own.join(below, ["m", "size"]).select(F.least("ga", "gid").alias("ga"), F.greatest("ga", "gid").alias("gb")).unionByName(
        own.select(F.col("gid").alias("ga"), F.col("gid").alias("gb"))
    )
    links = _links(docs, groups, units.distinct(), classes, words, percent, twins)
    labels = shared.components(links).select(F.col("node").alias("k"), F.col("comp").alias("cluster"))
    found = groups.drop("cluster").join(labels, "k", "left")
    found = shared.written(found, "clustered-sets")
    # Clusters are cut by hash; what a split family leaves over is grouped anew, by its own weight.
    kind = F.expr("if(cluster is not null, 1, if(parts > 1, 2, 0))")
    found = found.withColumn("kind", kind).withColumn("whole", F.expr("if(kind = 1, cluster, m)"))
    weight = found.where("kind > 0").groupBy("kind", "whole").agg(F.ceil(F.sum("n") / F.lit(GROUP_TOKENS)).cast("long").alias("pieces"))
    found = found.join(weight, ["kind", "whole"], "left")
    gid = F.expr("case kind when 1 then xxhash64('cluster', cluster, pmod(k, pieces)) when 2 then xxhash64('rest', m, pmod(k, pieces), size) end")
    return shared.written(found.select("k", "n", "m", F.coalesce(gid, "gid").alias("gid"), "cluster"), "groups"), links


def _classified(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """``jaccard_components`` with three more columns: ``t``, a digest of the text, ``k``, the class of equal sets (0 without words), and ``one``, the class that stands for the component.

    It is that of the smallest id, the smallest class of several (and of a component of null ids only).
    """
    with shared.scratch(docs.sparkSession) as held:
        return held.kept(_components_of(docs, id_col, text_col, words, percent), "jaccard-components")


def _components_of(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    shared.bounded_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    place = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "t")  # rows with an id come first
    scan = docs.mapInArrow(_scan(words, 3), "doc_id long, t long, n long, k long, second long, hot boolean")
    scan = shared.written(scan, "shingles")
    ids = scan.where("not hot").drop("hot")
    same = ids.where("n > 0").groupBy("k").agg(F.min("second").alias("lo"), F.max("second").alias("hi"), F.min(place).alias("at"), F.count("*").alias("n_copies"))
    classes = shared.written(same, "classes")
    twins = frozenset(x.k for x in classes.where("lo <> hi").select("k").collect())
    if twins:  # different sets that share 64 bits: about one pair in ten billion sets
        ids = ids.withColumn("k", F.when(F.col("k").isin(list(twins)), F.col("second")).otherwise(F.col("k")))
        classes = shared.written(ids.where("n > 0").groupBy("k").agg(F.min(place).alias("at"), F.count("*").alias("n_copies")), "classes")
    counted = scan.where("hot").groupBy(F.col("k").alias("token")).agg(F.sum("n").alias("df"))
    hot = _most_shared(shared.written(counted, "shared-tokens"))

    prefix = docs.mapInArrow(_prefixes(words, percent, hot, twins), "token long, k long, n int, hot boolean")
    # Shared tokens are known to be shared, so their rows need not meet; the salt spreads them.
    salt = F.when(F.col("hot"), F.pmod(F.col("k"), F.lit(_SALTS)).cast("int")).otherwise(F.lit(-1))
    spread = Window.partitionBy("token", "salt")
    kept = (
        prefix.withColumn("salt", salt)
        .withColumn("lo", F.min("k").over(spread))
        .withColumn("hi", F.max("k").over(spread))
        .where("hot or lo <> hi")
        .select("token", "k", "n")
        .distinct()
    )
    kept = shared.written(kept, "prefix")
    df = kept.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    matrix = kept.join(df, "token")
    # Of its prefix, a set with a partner shares as many tokens as the smaller of the two is asked for.
    enough = matrix.groupBy("k").agg(F.count("*").alias("common"), F.first("n").alias("_n")).where(f"common >= 1 + ({percent} * _n div 100) div 20")
    matrix = shared.written(matrix.join(enough.select("k"), "k", "left_semi"), "matrix")
    home = matrix.groupBy("k").agg(F.max_by("token", F.struct("df", "token")).alias("m"), F.first("n").alias("n"))
    weight = home.groupBy("m").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / F.lit(GROUP_TOKENS))).cast("long").alias("parts"))
    # Sets of one group differ in size by less than a factor of two, so that its bounds stay sharp.
    part, size = F.pmod(F.col("k"), F.col("parts")), F.floor(F.log2("n")).cast("int")
    groups = home.join(weight, "m").select("k", "n", "m", part.alias("part"), "parts", size.alias("size"), F.xxhash64("m", part, size).alias("gid"), F.lit(None).cast("long").alias("cluster"))
    groups = shared.written(groups, "groups")
    links = None
    if groups.where("parts > 1").limit(1).count():
        groups, links = _clusters(docs, groups, classes, words, percent, twins)

    # In the matrix a cluster is one entry, which is opened in parts; a group that stands for itself is its only part.
    entry = F.coalesce(F.col("cluster"), F.col("gid")).alias("entry")
    parts = groups.select(entry, "gid").distinct()
    inner = groups.groupBy(entry).agg(F.count("*").alias("members"), F.min("n").alias("least"), F.max(F.col("cluster").isNotNull()).alias("clustered"))
    rows = (
        matrix.select("token", "k").join(groups.select("k", "n", entry), "k").groupBy("token", "entry").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
        .join(inner.select("entry", "least"), "entry")
    )
    rows = shared.written(rows, "token-groups")
    a, b = rows.alias("a"), rows.alias("b")
    pairs = (
        a.join(b, F.expr(f"a.token = b.token and a.entry < b.entry and a.hi * 100 >= b.lo * {percent} and b.hi * 100 >= a.lo * {percent}"))
        .groupBy(F.col("a.entry").alias("ea"), F.col("b.entry").alias("eb"))
        .agg(F.count("*").alias("common"), F.min(F.least("a.least", "b.least")).alias("least"))
        .where(F.expr("common >= 1 + least div 20"))
    )
    pairs = shared.written(pairs.select("ea", "eb"), "entry-pairs")
    alone = inner.where("members > 1 and not clustered").select(F.col("entry").alias("ga"), F.col("entry").alias("gb"))
    # A pair with a cluster is opened at one place first; where that joins two clusters, the rest of their parts need not meet.
    place = parts.groupBy("entry").agg(F.min("gid").alias("gid"), F.count("*").alias("pieces"))
    firsts = pairs.join(place.select(*(F.col(x).alias(y) for x, y in (("entry", "ea"), ("gid", "ga"), ("pieces", "pa")))), "ea")
    firsts = firsts.join(place.select(*(F.col(x).alias(y) for x, y in (("entry", "eb"), ("gid", "gb"), ("pieces", "pb")))), "eb")
    firsts = shared.written(firsts, "first-units")
    more = _links(docs, groups, firsts.select("ga", "gb").unionByName(alone), classes, words, percent, twins)
    if links is None:
        links = more
    else:
        links = links.unionByName(more)
        # A cluster goes by the name of one of its sets, and all of it is in that set's component.
        now = shared.written(shared.components(links), "clusters-now")
        several = firsts.where("pa * pb > 1")
        for side in "ab":
            several = several.join(now.select(F.col("node").alias(f"e{side}"), F.col("comp").alias(f"c{side}")), f"e{side}", "left")
        rest = several.where("ca is null or cb is null or ca <> cb")
        for side in "ab":
            rest = rest.join(parts.select(F.col("entry").alias(f"e{side}"), F.col("gid").alias(f"g{side}_")), f"e{side}")
        rest = rest.where("ga <> ga_ or gb <> gb_").select(F.col("ga_").alias("ga"), F.col("gb_").alias("gb"))
        links = links.unionByName(_links(docs, groups, rest, classes, words, percent, twins))

    comp = shared.components(links)
    low = comp.join(classes.select(F.col("k").alias("node"), F.col("at.doc_id").alias("low")), "node")
    first = F.min(F.struct(F.col("low").isNull().alias("null"), "low", "node"))
    least = low.groupBy("comp").agg(F.min("low").alias("least"), first["node"].alias("one"))
    of_class = comp.join(least, "comp").select(F.col("node").alias("k"), "least", "one")
    named = classes.join(of_class, "k", "left").select("k", "n_copies", F.coalesce("least", "at.doc_id").alias("component_id"), F.coalesce("one", "k").alias("one"))
    named = shared.written(named, "named-classes")
    some = shared.joined_skewed(ids.where("n > 0"), named, "k", F.col("n_copies"), ids.count())
    some = some.select("doc_id", "t", F.col("n").alias("n_shingles"), "component_id", "n_copies", "k", "one")
    none = ids.where("n = 0").select("doc_id", "t", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_copies"), "k", F.col("k").alias("one"))
    return some.unionByName(none)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, n_copies``.

    Texts are lower-cased in A-Z and split into words ``[^\\x20\\x09-\\x0D]+``; a document's set holds its distinct shingles of
    ``words`` words (with fewer words, the whole sequence).  Documents are linked when their Jaccard similarity is at
    least ``percent``/100 in integer arithmetic; ``component_id`` is the smallest id reachable by links, itself
    included, and ``n_copies`` counts the rows with the same set.  No two components that a link joins come out apart.

    Null or blank texts have n_shingles 0, link with nothing and keep their own id.  Rows with a null id are kept;
    they count in components by the ids of the others (null if there is none).  Repeated rows come out repeatedly.
    Other columns of ``docs`` are ignored, so their names cannot clash.  Shingles are told apart by a 64-bit hash, sets by 128 bits.
    """
    return _classified(docs, id_col, text_col, words, percent).select("doc_id", "n_shingles", "component_id", "n_copies")


def one_per_component(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are kept when one document of each component stays: the one with the smallest doc_id.

    Documents without words are kept.  Of several rows of a component with its smallest doc_id (or of a component of null ids
    only) one row of the smallest set digest stays; rows that share an id but no component are different documents.  Columns
    of any name pass unchanged.
    """
    with shared.scratch(docs.sparkSession) as held:
        found = _classified(docs, "doc_id", "text", words, percent).where("n_shingles > 0")
        first = F.col("k").eqNullSafe(F.col("one")) & F.col("doc_id").eqNullSafe(F.col("component_id"))
        # The rows that stay, by id and set; of equal sets the smallest digest of a text.
        stays = shared.written(found.where(first).groupBy("doc_id", "k").agg(F.min("t").alias("t")), "staying")
        gone = found.select("doc_id", "t").distinct().join(stays.select("doc_id", "t", F.lit(True).alias("stays")).withColumnsRenamed({"doc_id": "_d", "t": "_t"}), F.expr("doc_id <=> _d and t <=> _t"), "left_anti")
        gone = held.kept(gone, "gone")
        again = found.where(first).groupBy("doc_id", "t").count().where("count > 1").select("doc_id", "t")
        again = held.kept(again, "repeated")
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own")
    rows = docs.select(own, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("t"))
    # As a rule few documents go; texts that are not among them are not shuffled.
    kept = shared.looked_up(rows, gone, ["doc_id", "t"], "left_anti")
    if again.limit(1).count():
        repeated = shared.looked_up(kept, again, ["doc_id", "t"], "left_semi").dropDuplicates(["doc_id", "t"])
        kept = shared.looked_up(kept, again, ["doc_id", "t"], "left_anti").unionByName(repeated)
    return kept.select(*(F.col("own").getField(c).alias(c) for c in docs.columns))
