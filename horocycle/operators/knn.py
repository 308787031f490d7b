"""Exact geodesic nearest neighbours.

Up to a checked bound the prototypes are one matrix on every worker, and the queries are dealt to as many tasks as the number of pairs asks
for.  More prototypes stay on the executors: they and the queries are dealt to blocks of bounded size, every pair of blocks is one task's
work, and the partial top-k lists are merged per query.  Before that some of the prototypes give each query a distance that its k nearest
are within, so that the blocks need not begin without limits.  Among the same points a pair of blocks is met once, for both sides.  Ties go
to the smaller id.

Within a block a matrix product of single precision gives a lower bound of each distance; pairs whose bound is within the k-th exact
distance found so far are computed in double precision, so that no neighbour is missed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from horocycle.functions import geometry as G
from horocycle.functions import numeric as N
from horocycle.functions.constants import KAPPA, TOP_K

#: Doubles in one block of prototypes, and of queries where these are dealt, too: 32 MB on a worker.
BLOCK_VALUES = 1 << 22
#: The same where there is nothing but one block: prototypes of a stream, or all ranks of a descent.
WORKER_VALUES = 1 << 23
#: Pairs of a task, and tasks for each core, that these may be even.
TASK_PAIRS, CORE_TASKS = 1 << 28, 3
#: Rows and columns of the bounds that are held at once (4 MB, near what a core caches), and doubles of points whose exact distances
#: are computed at once.
_ROWS, _COLUMNS, _EXACT = 1024, 1024, 1 << 18
#: Distances that are held at once next to the rim.
_RIM = 1 << 20
#: Up to so many points all distances are exact from the start.
_FEW = 512
#: Part of a block's size that is taken of the prototypes for the first limits: half by a hash, half those of least norm (often near).
FIRST = 0.25
#: Pairs up to which the join in built-in expressions is planned.
SQL_PAIRS = 1 << 20


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column without nulls, all of one length, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _every(q: np.ndarray, points: np.ndarray, k: int, kappa: float, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``nearest`` from all distances; rows and points of any norm."""
    n = len(points)
    take = min(k + 8, n)
    norms, nq = (points * points).sum(1), (q * q).sum(1)
    near = N.distance_from(np.maximum(nq[:, None] + norms[None, :] - 2 * (q @ points.T), 0), nq[:, None], norms[None, :], kappa)
    if own is not None:
        rows = np.flatnonzero(own >= 0)
        near[rows, own[rows]] = np.inf
    some = np.argpartition(near, take - 1, axis=1)[:, :take] if take < n else np.tile(np.arange(n), (len(q), 1))
    exact = N.distance(q[:, None, :], points[some], kappa)
    rough = np.take_along_axis(near, some, 1)
    exact[~np.isfinite(rough)] = np.inf
    order = np.lexsort((some, exact), axis=1)[:, :k]
    place, dist = np.take_along_axis(some, order, 1), np.take_along_axis(exact, order, 1)
    if take < n:  # more ties than spare places: look at all of them
        edge = rough.max(1)
        for i in np.flatnonzero((rough < edge[:, None]).sum(1) < k):
            every = np.flatnonzero(near[i] <= edge[i])
            all_exact = N.distance(q[i][None, :], points[every], kappa)
            all_exact[~np.isfinite(near[i, every])] = np.inf
            order = np.lexsort((every, all_exact))[:k]
            place[i], dist[i] = every[order], all_exact[order]
    return place, dist


class Screen:
    """Lower bounds of ``squared distance / (1 - kappa |p|^2)`` by one product in single precision.

    The product's terms for q and p add up to at most 2 (|q|^2 + |p|^2) / (1 - kappa |p|^2) in size; its rounding is within ``slack``
    of that, which is subtracted.
    """

    def __init__(self, points: np.ndarray, kappa: float) -> None:
        self.norms = (points * points).sum(1)
        self.room = 1 - kappa * self.norms
        self.least = float(self.room.min())
        with np.errstate(divide="ignore", over="ignore"):
            w = 1 / self.room
        self.slack = 1 - 4 * (points.shape[1] + 16) * 2.0**-24
        self.right = np.empty((points.shape[1] + 2, len(points)), np.float32)
        for lo in range(0, len(points), _COLUMNS):
            at = slice(lo, lo + _COLUMNS)
            self.right[:-2, at] = (-2 * w[at, None] * points[at]).T
        self.right[-2], self.right[-1] = w * self.norms * self.slack, w * self.slack

    def left(self, q: np.ndarray, nq: np.ndarray) -> np.ndarray:
        return np.concatenate([q, np.ones((len(q), 1)), nq[:, None]], 1).astype(np.float32)


def _exactly(q: np.ndarray, nq: np.ndarray, points: np.ndarray, screen: Screen, row: np.ndarray, place: np.ndarray, kappa: float) -> tuple[np.ndarray, np.ndarray]:
    """(distance, what the screen bounds) of pairs."""
    sq = np.empty(len(row))
    step = max(1, _EXACT // max(1, q.shape[1]))
    for lo in range(0, len(row), step):
        at = slice(lo, lo + step)
        sq[at] = ((q[row[at]] - points[place[at]]) ** 2).sum(-1)
    return N.distance_from(sq, nq[row], screen.norms[place], kappa), np.maximum(sq, 1e-15) / screen.room[place]


class _Hits:
    """Where rows of bounds are within their limits; the room for both is used again for each block."""

    def __init__(self, most: int) -> None:
        self.low, self.within = np.empty(most, np.float32), np.empty(-(-most // 8) * 8, bool)

    def bounds(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        shape = len(left), right.shape[1]
        return np.matmul(left, right, out=self.low[: shape[0] * shape[1]].reshape(shape))

    def places(self, low: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Flat places, ascending; rows are passed over where none is, and eight at a time."""
        rows = np.flatnonzero(low.min(1) <= limit)
        if 4 * len(rows) < len(low):
            row, at = np.nonzero(low[rows] <= limit[rows, None])
            return rows[row] * low.shape[1] + at
        np.less_equal(low, limit[:, None], out=self.within[: low.size].reshape(low.shape))
        eights = -(-low.size // 8)
        self.within[low.size : eights * 8] = False
        some = np.flatnonzero(self.within[: eights * 8].view(np.uint64))
        word, bit = np.nonzero(self.within.reshape(-1, 8)[some])
        return some[word] * 8 + bit


def _limits(worst: np.ndarray) -> np.ndarray:
    return np.nextafter((worst * (1 + 1e-9)).astype(np.float32), np.float32(np.inf))


def _bounds_of(dist: np.ndarray, kappa: float) -> np.ndarray:
    """``squared distance / ((1 - kappa |q|^2) (1 - kappa |p|^2))`` of geodesic distances."""
    s = math.sqrt(kappa)
    with np.errstate(over="ignore"):
        return (np.sinh(np.asarray(dist) * (s / 2)) / s) ** 2


class _Best:
    """The k nearest so far of each row: places (``none`` where there are fewer), distances, and the limit of the screen's bounds."""

    def __init__(self, many: int, k: int, none: int, limit: np.ndarray) -> None:
        self.k, self.limit = k, limit
        self.place, self.dist, self.bound = np.full((many, k), none), np.full((many, k), np.inf), np.full((many, k), np.inf)

    def add(self, row: np.ndarray, at: np.ndarray, d: np.ndarray, b: np.ndarray) -> None:
        k, seen = self.k, np.unique(row)
        row = np.concatenate([row, np.repeat(seen, k)])
        at, d, b = (np.concatenate([new, old[seen].ravel()]) for new, old in ((at, self.place), (d, self.dist), (b, self.bound)))
        order = np.lexsort((at, d, row))
        row, at, d, b = row[order], at[order], d[order], b[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        kept = rank < k
        row, rank = row[kept], rank[kept]
        self.place[row, rank], self.dist[row, rank], self.bound[row, rank] = at[kept], d[kept], b[kept]
        self.limit[seen] = np.minimum(self.limit[seen], _limits(self.bound[seen].max(1)))


def _screened(q: np.ndarray, points: np.ndarray, screen: Screen, k: int, kappa: float, own: np.ndarray | None, most: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    n, many = len(points), len(q)
    k = min(k, n)
    nq = (q * q).sum(1)
    left = screen.left(q, nq)
    limit = np.full(many, np.inf, np.float32) if most is None else _limits(_bounds_of(most, kappa) * (1 - kappa * nq))
    best, hits = _Best(many, k, n, limit), _Hits(many * min(n, _COLUMNS))
    for lo in range(0, n, _COLUMNS):
        low = hits.bounds(left, screen.right[:, lo : lo + _COLUMNS])
        width = low.shape[1]
        if not lo and width > k + 8 and not np.isfinite(limit).all():  # a first limit, from a few of the first points
            some = np.argpartition(low, k + 4, axis=1)[:, : k + 5]
            row = np.repeat(np.arange(many), k + 5)
            _, first = _exactly(q, nq, points, screen, row, some.ravel(), kappa)
            if own is not None:
                first[some.ravel() == own[row]] = np.inf
            best.limit = np.minimum(limit, _limits(np.sort(first.reshape(many, -1), axis=1)[:, k - 1]))
        hit = hits.places(low, best.limit)
        row, at = hit // width, hit % width + lo
        if own is not None:
            other = own[row] != at
            row, at = row[other], at[other]
        if len(row):
            best.add(row, at, *_exactly(q, nq, points, screen, row, at, kappa))
    return np.minimum(best.place, n - 1), best.dist


def mutual(a: Block, b: Block, k: int, kappa: float, most_a: np.ndarray, most_b: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """``nearest`` of each point of ``a`` in ``b`` within ``most_a``, and of each of ``b`` in ``a`` within ``most_b``, from one product."""
    there, back = b.screen(kappa), a.screen(kappa)
    if there is None or back is None or not there.least * back.least >= 2e-8 or there.least <= 0 or not (np.isfinite(most_a).all() and np.isfinite(most_b).all()):
        return nearest(a.points, b.points, k, kappa, None, there, most_a), nearest(b.points, a.points, k, kappa, None, back, most_b)
    left = (np.concatenate([a.points, np.ones((len(a.points), 1)), back.norms[:, None]], 1) / back.room[:, None]).astype(np.float32)
    hits = _Hits(_ROWS * min(len(b.points), _COLUMNS))
    of_a, of_b = (_Best(len(x.points), min(k, len(y.points)), len(y.points), _limits(_bounds_of(most, kappa))) for x, y, most in ((a, b, most_a), (b, a, most_b)))
    for lo in range(0, len(a.points), _ROWS):
        for first in range(0, len(b.points), _COLUMNS):
            low = hits.bounds(left[lo : lo + _ROWS], there.right[:, first : first + _COLUMNS])
            hit = hits.places(low, of_a.limit[lo : lo + _ROWS])
            if len(hit):
                row, at = hit // low.shape[1] + lo, hit % low.shape[1] + first
                d, bound = _exactly(a.points, back.norms, b.points, there, row, at, kappa)
                of_a.add(row, at, d, bound / back.room[row])
            limit = of_b.limit[first : first + _COLUMNS]
            some = np.flatnonzero(low.min(0) <= limit)
            if len(some):
                at, row = np.nonzero(low[:, some] <= limit[some])
                row, at = some[row] + first, at + lo
                d, bound = _exactly(b.points, there.norms, a.points, back, row, at, kappa)
                of_b.add(row, at, d, bound / there.room[row])
    return (np.minimum(of_a.place, len(b.points) - 1), of_a.dist), (np.minimum(of_b.place, len(a.points) - 1), of_b.dist)


def nearest(q: np.ndarray, points: np.ndarray, k: int, kappa: float, own: np.ndarray | None = None, screen: Screen | None = None, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of the k nearest ``points`` of each row of ``q``, nearest first, ties by place; infinite where there are fewer.

    ``own`` names a point that is not a neighbour of the row (-1: none); ``screen`` is that of the points, if it is there already.
    Points farther than ``most`` may be left out.
    """
    if len(points) <= _FEW:
        return _every(q, points, k, kappa, own)
    screen = screen or Screen(points, kappa)
    place, dist = np.zeros((len(q), min(k, len(points))), np.int64), np.zeros((len(q), min(k, len(points))))
    # The formula's least room is out of the screen's reach: all distances where both points are next to the rim.
    rim = ~((1 - kappa * (q * q).sum(1)) * screen.least >= 2e-8) | (screen.least <= 0)
    for rows, how in ((np.flatnonzero(~rim), _ROWS), (np.flatnonzero(rim), max(1, _RIM // len(points)))):
        for lo in range(0, len(rows), how):
            at = rows[lo : lo + how]
            mine = None if own is None else own[at]
            within = None if most is None else most[at]
            place[at], dist[at] = _every(q[at], points, k, kappa, mine) if rim[at[0]] else _screened(q[at], points, screen, k, kappa, mine, within)
    return place, dist


class Block:
    """Prototypes in order of their ids."""

    def __init__(self, ids: pa.Array, embeddings: pa.Array) -> None:
        keys = np.array(ids.to_pylist(), object if pa.types.is_string(ids.type) else np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ids = keys[order], ids.take(pa.array(order))
        self.points = np.ascontiguousarray(matrix(embeddings)[order])
        self.screens: dict[float, Screen] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"screens": {}}

    def screen(self, kappa: float) -> Screen | None:
        if kappa not in self.screens and len(self.points) > _FEW:
            self.screens[kappa] = Screen(self.points, kappa)
        return self.screens.get(kappa)

    def own(self, names: pa.Array) -> np.ndarray:
        """The place of each id, or -1."""
        keys = np.array(names.to_pylist(), self.keys.dtype)
        own = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[own] == keys, own, -1)

    def ranked(self, qid: pa.Array, place: np.ndarray, dist: np.ndarray) -> pa.RecordBatch:
        """``qid, rk, id, dist`` of what was found for queries."""
        row, rank = np.nonzero(np.isfinite(dist))
        return pa.RecordBatch.from_arrays(
            [qid.take(pa.array(row)), pa.array(rank + 1, pa.int32()), self.ids.take(pa.array(place[row, rank])), pa.array(dist[row, rank])], names=["qid", "rk", "id", "dist"]
        )

    def search(self, qid: pa.Array, embeddings: pa.Array, k: int, kappa: float, others: bool, most: pa.Array | None = None) -> Iterator[pa.RecordBatch]:
        """``qid, rk, id, dist`` of batches of queries, those within ``most`` at least."""
        for lo in range(0, len(qid) if len(self.points) else 0, _ROWS):
            part, q = qid.slice(lo, _ROWS), matrix(embeddings.slice(lo, _ROWS))
            within = None if most is None else most.slice(lo, _ROWS).to_numpy(zero_copy_only=False)
            yield self.ranked(part, *nearest(q, self.points, k, kappa, self.own(part) if others else None, self.screen(kappa), within))

    def limits(self, qid: pa.Array, embeddings: pa.Array, k: int, kappa: float, others: bool) -> Iterator[pa.RecordBatch]:
        """``qid, embedding, most``: the distance of the k-th nearest, infinite where there are fewer."""
        for lo in range(0, len(qid), _ROWS):
            part, z = qid.slice(lo, _ROWS), embeddings.slice(lo, _ROWS)
            most = np.full(len(part), np.inf)
            if len(self.points) >= k:
                most = nearest(matrix(z), self.points, k, kappa, self.own(part) if others else None, self.screen(kappa))[1][:, k - 1]
            yield pa.RecordBatch.from_arrays([part, z, pa.array(most)], names=["qid", "embedding", "most"])


def _values(points: DataFrame) -> tuple[int, int]:
    """(rows, doubles in them) without those that have no embedding."""
    found = points.where("embedding is not null").agg(F.count("*"), F.sum(F.size("embedding"))).first()
    return found[0], found[1] or 0


def fits_one_block(prototypes: DataFrame) -> bool:
    return _values(prototypes)[1] <= WORKER_VALUES


Search = Callable[[Block, pa.Array, pa.Array], Iterable[pa.RecordBatch]]


def _by_one(queries: DataFrame, pairs: Callable[[], int], prototypes: pa.Table, search: Search, schema: str) -> DataFrame:
    """Rows that ``search`` makes of all queries against a block that goes to every worker; ``pairs`` counts these."""
    block = Block(prototypes["id"].combine_chunks(), prototypes["embedding"].combine_chunks())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from search(block, *batch.columns)

    if not queries.isStreaming and (tasks := math.ceil(pairs() / TASK_PAIRS)) > 1:
        queries = queries.repartition(max(tasks, queries.sparkSession.sparkContext.defaultParallelism), "qid")
    return queries.mapInArrow(run, schema)


def by_blocks(queries: DataFrame, prototypes: DataFrame, search: Search, kinds: dict[str, str], sizes: tuple | None = None) -> tuple[DataFrame, bool]:
    """(rows that ``search(block, qid, embedding)`` makes of all queries against all prototypes, whether these are in several blocks).

    In several blocks each query meets each block once, in a call of its own.  A column ``most`` of the queries is handed on.  ``sizes`` are
    ``_values`` of the prototypes and, where these are in several blocks, of the queries, if they are known.
    """
    given = ["most"] if "most" in queries.columns else []
    queries = queries.select("qid", F.col("embedding").cast("array<double>").alias("embedding"), *given).where("embedding is not null")
    kind = "string" if dict(prototypes.dtypes)["id"] == "string" else "bigint"
    prototypes = prototypes.select(F.col("id").cast(kind).alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    schema = ", ".join(f"{name} {of}" for name, of in kinds.items())
    (there, size), mine = sizes or (_values(prototypes), None)
    if size <= (WORKER_VALUES if queries.isStreaming else BLOCK_VALUES):
        return _by_one(queries, lambda: queries.count() * there, prototypes.toArrow(), search, schema), False
    if queries.isStreaming:
        raise ValueError("the prototypes of a stream must fit one block")
    many, values = mine or _values(queries)
    across = 2 * math.ceil(size / BLOCK_VALUES)
    even = math.ceil(CORE_TASKS * queries.sparkSession.sparkContext.defaultParallelism / across)
    down = max(math.ceil(values / BLOCK_VALUES), min(even, math.ceil(many / _ROWS)))
    left = queries.select("*", F.pmod(F.xxhash64("qid"), F.lit(down)).alias("_q"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))).alias("_p"))
    right = prototypes.select("*", F.pmod(F.xxhash64("id"), F.lit(across)).alias("_p"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))).alias("_q"))
    fields = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in T._parse_datatype_string(schema)])

    def pair(some: pa.Table, block: pa.Table) -> pa.Table:
        found = []
        if some.num_rows and block.num_rows:
            found = search(Block(block["id"].combine_chunks(), block["embedding"].combine_chunks()), *(some[x].combine_chunks() for x in ("qid", "embedding", *given)))
        return pa.Table.from_batches([x.cast(fields) for x in found], fields)

    return left.groupBy("_p", "_q").cogroup(right.groupBy("_p", "_q")).applyInArrow(pair, schema), True


def _limited(queries: DataFrame, prototypes: DataFrame, many: int, size: int, k: int, kappa: float, others: bool) -> DataFrame:
    """``qid, embedding, most``: the k-th distance of each of ``many`` queries to some of the prototypes, which are ``size`` doubles."""
    kind = "string" if dict(prototypes.dtypes)["id"] == "string" else "bigint"
    rows, prototypes = (
        x.select(id, F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
        for x, id in ((queries, "qid"), (prototypes, F.col("id").cast(kind).alias("id")))
    )
    share, norm = FIRST * BLOCK_VALUES / size / 2, G.norm2(F.col("embedding"))
    hashed = F.pmod(F.xxhash64("id", F.lit("first")), F.lit(1 << 20)) < int(share * (1 << 20))
    cut = prototypes.agg(F.percentile_approx(norm, F.lit(share), F.lit(10_000))).first()[0]
    some = prototypes.where(hashed | (norm < F.lit(cut))).toArrow()
    schema = f"qid {dict(queries.dtypes)['qid']}, embedding array<double>, most double"
    return _by_one(rows, lambda: many * some.num_rows, some, lambda block, qid, z: block.limits(qid, z, k, kappa, others), schema)


def _merged(parts: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("qid").orderBy("dist", "id")
    return parts.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= k)


def geodesic_knn(queries: DataFrame, prototypes: DataFrame, k: int = TOP_K, kappa: float = KAPPA, others: bool = False) -> DataFrame:
    """``qid, rk, id, dist``: the k nearest of ``prototypes(id, embedding)`` for each of ``queries(qid, embedding)``.

    With ``others`` a query is not its own neighbour (equal ids).  Fewer prototypes than k give fewer rows; none give no rows;
    rows without an embedding are left out on either side.  Works on streaming queries as long as the prototypes fit one block.
    """
    kinds = {"qid": dict(queries.dtypes)["qid"], "rk": "int", "id": "string" if dict(prototypes.dtypes)["id"] == "string" else "bigint", "dist": "double"}
    sizes = _values(prototypes), None
    if sizes[0][1] > BLOCK_VALUES and not queries.isStreaming:
        sizes = sizes[0], _values(queries)
        queries = _limited(queries, prototypes, sizes[1][0], sizes[0][1], k, kappa, others)
    parts, several = by_blocks(queries, prototypes, lambda block, qid, z, most=None: block.search(qid, z, k, kappa, others, most), kinds, sizes)
    return _merged(parts, k) if several else parts


def geodesic_others(points: DataFrame, k: int = TOP_K, kappa: float = KAPPA) -> DataFrame:
    """``qid, rk, id, dist``: the k nearest others of each of ``points(id, embedding)``; ids are unique."""
    rows = points.select(F.col("id").alias("qid"), "embedding")
    there, size = _values(points)
    if size <= BLOCK_VALUES:
        return geodesic_knn(rows, points, k, kappa, others=True)
    of, kind = dict(points.dtypes)["id"], "string" if dict(points.dtypes)["id"] == "string" else "bigint"
    tasks = min(CORE_TASKS * points.sparkSession.sparkContext.defaultParallelism, math.ceil(there * there / 2 / TASK_PAIRS))
    blocks = max(2 * math.ceil(size / BLOCK_VALUES), math.ceil((math.sqrt(8 * tasks + 1) - 1) / 2))
    mine = _limited(rows.withColumn("qid", F.col("qid").cast(kind)), points, there, size, k, kappa, True)
    mine = mine.withColumn("_b", F.pmod(F.xxhash64("qid"), F.lit(blocks))).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    low, high = F.least("_b", "_o"), F.greatest("_b", "_o")
    mine = mine.withColumn("_u", (high * (high + 1) / 2 + low).cast("int")).drop("_o")  # each pair of blocks has a number and a task
    mine = mine.repartitionById(blocks * (blocks + 1) // 2, F.col("_u"))
    schema = f"qid {kind}, rk int, id {kind}, dist double"
    fields = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in T._parse_datatype_string(schema)])

    def side(rows: pa.Table) -> tuple[Block, np.ndarray]:
        block, most = Block(rows["qid"].combine_chunks(), rows["embedding"].combine_chunks()), np.empty(len(rows))
        most[block.own(rows["qid"])] = rows["most"].to_numpy()
        return block, most

    def pair(key: tuple, rows: pa.Table) -> pa.Table:
        j = (math.isqrt(8 * key[0].as_py() + 1) - 1) // 2
        i = key[0].as_py() - j * (j + 1) // 2
        found = []
        if i == j:
            block, most = side(rows)
            found = [block.ranked(block.ids, *nearest(block.points, block.points, k, kappa, np.arange(len(block.keys)), block.screen(kappa), most))]
        else:
            parts = [rows.filter(pc.equal(rows["_b"], x)) for x in (i, j)]
            if all(x.num_rows for x in parts):
                del rows
                (a, most_a), (b, most_b) = (side(x) for x in parts)
                del parts
                there, back = mutual(a, b, k, kappa, most_a, most_b)
                found = [b.ranked(a.ids, *there), a.ranked(b.ids, *back)]
        return pa.Table.from_batches([x.cast(fields) for x in found], fields)

    return _merged(mine.groupBy("_u").applyInArrow(pair, schema), k).withColumn("qid", F.col("qid").cast(of))


def geodesic_knn_sql(queries: DataFrame, prototypes: DataFrame, k: int = TOP_K, kappa: float = KAPPA, others: bool = False) -> DataFrame:
    """The same by a nested-loop join and a window, in built-in expressions, while there are few pairs; more go by ``geodesic_knn``."""
    if queries.count() * prototypes.count() > SQL_PAIRS:
        return geodesic_knn(queries, prototypes, k, kappa, others)
    q = queries.select("qid", F.col("embedding").alias("_q"), G.norm2(F.col("embedding")).alias("_nq"))
    p = prototypes.select("id", F.col("embedding").alias("_p"), G.norm2(F.col("embedding")).alias("_np"))
    pairs = q.join(p, q.qid != p.id) if others else q.crossJoin(p)
    sq = F.aggregate(F.zip_with("_q", "_p", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    pairs = pairs.select("qid", "id", G.distance_from(sq, F.col("_nq"), F.col("_np"), kappa).alias("dist"))
    best = Window.partitionBy("qid").orderBy("dist", "id")
    return pairs.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= k).select("qid", "rk", "id", "dist")


def margins(neighbours: DataFrame) -> DataFrame:
    """``qid, id, dist, margin``: the nearest, and how much farther the second is (infinity if there is none)."""
    two = neighbours.where("rk <= 2").groupBy("qid").agg(
        F.min_by("id", "rk").alias("id"), F.min("dist").alias("dist"), F.max("dist").alias("_second"), F.count("*").alias("_n")
    )
    margin = F.when(F.col("_n") > 1, F.col("_second") - F.col("dist")).otherwise(F.lit(math.inf))
    return two.select("qid", "id", "dist", margin.alias("margin"))


def _later(block: Block, ids: pa.Array, embeddings: pa.Array, kappa: float) -> Iterator[tuple[pa.Array, int, np.ndarray, np.ndarray]]:
    """(ids of rows, first place, their distances to the block's points from there on, which of these are later than the row)."""
    names = np.array(ids.to_pylist(), block.keys.dtype)
    order = np.argsort(names, kind="stable")
    names, ids, z = names[order], ids.take(pa.array(order)), matrix(embeddings)[order]
    for lo in range(0, len(names), _ROWS // 4):
        at = slice(lo, lo + _ROWS // 4)
        after = np.searchsorted(block.keys, names[at], side="right")
        for first in range(int(after[0]), len(block.keys), _ROWS):
            d = N.pairwise(z[at], block.points[first : first + _ROWS], kappa)
            yield ids.slice(lo, _ROWS // 4), first, d, np.arange(first, first + d.shape[1])[None, :] >= after[:, None]


def distance_matrix(points: DataFrame, kappa: float = KAPPA) -> DataFrame:
    """``i, j, dist`` for i < j over ``points(id, embedding)``: the upper triangle."""
    kind = "string" if dict(points.dtypes)["id"] == "string" else "bigint"

    def search(block: Block, ids: pa.Array, embeddings: pa.Array) -> Iterator[pa.RecordBatch]:
        for rows, first, d, later in _later(block, ids, embeddings, kappa):
            row, column = np.nonzero(later)
            yield pa.RecordBatch.from_arrays([rows.take(pa.array(row)), block.ids.take(pa.array(column + first)), pa.array(d[row, column])], names=["i", "j", "dist"])

    rows = points.select(F.col("id").cast(kind).alias("qid"), "embedding")
    found = by_blocks(rows, points, search, {"i": kind, "j": kind, "dist": "double"})[0]
    return found.select(*(F.col(x).cast(dict(points.dtypes)["id"]).alias(x) for x in "ij"), "dist")


def distance_stats(points: DataFrame, kappa: float = KAPPA) -> DataFrame:
    """``n_pairs, mean_distance, std_distance`` of the upper triangle, from sums of its blocks; no row per pair is made."""

    def search(block: Block, ids: pa.Array, embeddings: pa.Array) -> Iterator[pa.RecordBatch]:
        n, total, off = [], [], []
        for _, _, d, later in _later(block, ids, embeddings, kappa):
            x = d.ravel() if later.all() else d[later]
            if len(x):
                n.append(len(x))
                total.append(float(x.sum()))
                off.append(float(((x - total[-1] / len(x)) ** 2).sum()))
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(total, pa.float64()), pa.array(off, pa.float64())], names=["n", "total", "off"])

    rows = points.select(F.col("id").alias("qid"), "embedding")
    parts = by_blocks(rows, points, search, {"n": "bigint", "total": "double", "off": "double"})[0]
    sums = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("total").alias("t"), F.sum(F.col("off") + F.col("total") * F.col("total") / F.col("n")).alias("s"))
    n, mean = F.col("n"), F.col("t") / F.col("n")
    spread = F.when(n > 1, F.sqrt(F.greatest(F.col("s") - F.col("t") * mean, F.lit(0.0)) / (n - 1)))
    return sums.select(n.alias("n_pairs"), F.when(n > 0, mean).alias("mean_distance"), spread.alias("std_distance"))
