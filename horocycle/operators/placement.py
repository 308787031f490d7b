"""Placement of embedded sequences among prototypes: flat, and rank by rank down the lineages."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from horocycle.functions import geometry as G
from horocycle.functions.constants import KAPPA, TOP_K
from horocycle.operators import calibration as C
from horocycle.operators.knn import Block, fits_one_block, geodesic_knn, matrix, nearest


def _results(queries: DataFrame, found: DataFrame, prototypes: DataFrame, kappa: float) -> DataFrame:
    """One row per query from ranked candidates ``qid, rk, id, dist``."""
    info = prototypes.select(F.col("id"), "rank", "lineage")
    rows = found.join(info, "id")
    item = F.struct("rk", F.col("id").alias("taxon_id"), "rank", F.round("dist", 6).alias("distance"), "lineage")
    grouped = rows.groupBy("qid").agg(
        F.sort_array(F.collect_list(item)).alias("candidates"),
        F.min("dist").alias("best_distance"),
        F.min_by("id", "rk").alias("taxon_id"),
        F.min_by("rank", "rk").alias("rank"),
        F.min_by("lineage", "rk").alias("lineage"),
        F.min(F.when(F.col("rk") == 2, F.col("dist"))).alias("_second"),
    )
    out = queries.select("qid", "embedding").join(grouped, "qid", "left")
    return out.select(
        "qid",
        "taxon_id",
        "rank",
        F.coalesce("best_distance", F.lit(math.inf)).alias("best_distance"),
        F.coalesce(F.col("_second") - F.col("best_distance"), F.lit(math.inf)).alias("margin"),
        G.dist_from_origin(F.col("embedding"), kappa).alias("atlas_r"),
        G.angle(F.col("embedding")).alias("atlas_theta"),
        F.coalesce(F.array_join("lineage", ";"), F.lit("")).alias("lineage"),
        "candidates",
    )


def place_flat(queries: DataFrame, prototypes: DataFrame, k: int = TOP_K, kappa: float = KAPPA) -> DataFrame:
    """Nearest prototypes of all ranks for ``queries(qid, embedding)``; ``prototypes(id, rank, embedding, lineage)``."""
    return _results(queries, geodesic_knn(queries, prototypes, k, kappa), prototypes, kappa)


class Descent:
    """Prototypes by rank, and for each the places of those of the next populated rank below it."""

    def __init__(self, rows: pa.Table) -> None:
        ranks = rows["rank"].to_numpy()
        lineages = rows["lineage"].to_pylist()
        self.levels: list[Block] = []
        self.below: list[dict] = []
        for rank in np.unique(ranks):
            at = pa.array(np.flatnonzero(ranks == rank))
            level = Block(rows["id"].take(at).combine_chunks(), rows["embedding"].take(at).combine_chunks())
            lineage_of = dict(zip(rows["id"].take(at).to_pylist(), (lineages[i.as_py()] for i in at), strict=True))
            below: dict = {}
            for place, key in enumerate(level.keys.tolist()):
                for parent in set(lineage_of[key] or ()):
                    below.setdefault(parent, []).append(place)
            self.levels.append(level)
            self.below.append({parent: np.array(x) for parent, x in below.items()})

    def search(self, q: np.ndarray, k: int, kappa: float) -> Iterator[tuple[int, list[tuple[float, object]]]]:
        """(row, its k nearest candidates of all ranks as (distance, id))."""
        found: list[list] = [[] for _ in range(len(q))]
        ids = [level.keys.tolist() for level in self.levels]
        groups = [(np.arange(len(q)), np.arange(len(ids[0])))] if ids else []
        for depth, level in enumerate(self.levels):
            winner: dict = {}
            for rows, places in groups:
                near, dist = nearest(q[rows], level.points[places], k, kappa)
                for row, some, d in zip(rows.tolist(), places[near].tolist(), dist.tolist(), strict=True):
                    found[row].extend((x, ids[depth][p]) for x, p in zip(d, some, strict=True))
                    winner.setdefault(ids[depth][some[0]], []).append(row)
            if depth + 1 < len(self.levels):
                groups = [(np.array(rows), self.below[depth + 1][x]) for x, rows in winner.items() if x in self.below[depth + 1]]
        for row, candidates in enumerate(found):
            yield row, sorted(candidates)[:k]


def place_hierarchical(queries: DataFrame, prototypes: DataFrame, k: int = TOP_K, kappa: float = KAPPA) -> DataFrame:
    """Descend the populated ranks: at each, only prototypes whose lineage has the nearest one of the rank before.

    The candidates of all ranks are merged by distance.  A query stops where its nearest has no children.  Prototypes that fit one
    block go to every worker and queries descend in one pass without a shuffle; more are joined rank by rank.
    """
    if fits_one_block(prototypes):
        chosen = prototypes.select(F.col("id").cast("string").alias("id"), "rank", F.col("embedding").cast("array<double>").alias("embedding"), "lineage").where("embedding is not null")
        descent = Descent(chosen.toArrow())

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, ranks, ids, dists = [], [], [], []
                for row, candidates in descent.search(matrix(batch.column(1)), k, kappa):
                    for rank, (d, name) in enumerate(candidates, 1):
                        rows.append(row)
                        ranks.append(rank)
                        ids.append(name)
                        dists.append(d)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ranks, pa.int32()), pa.array(ids, pa.string()), pa.array(dists, pa.float64())], names=["qid", "rk", "id", "dist"])

        some = queries.select("qid", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
        return _results(queries, some.mapInArrow(run, f"qid {dict(queries.dtypes)['qid']}, rk int, id string, dist double"), prototypes, kappa)
    return _by_joins(queries, prototypes, k, kappa)


def _by_joins(queries: DataFrame, prototypes: DataFrame, k: int, kappa: float) -> DataFrame:
    ranks = sorted(r["rank"] for r in prototypes.select("rank").distinct().collect())
    best = Window.partitionBy("qid").orderBy("dist", "id")
    found, active = [], queries.select("qid", "embedding")
    parents: DataFrame | None = None
    for rank in ranks:
        level = prototypes.where(F.col("rank") == rank).select("id", F.col("embedding").alias("_p"), "lineage")
        if parents is None:
            pairs = geodesic_knn(active, level.select("id", F.col("_p").alias("embedding")), k, kappa).select("qid", "id", "dist", "rk")
        else:
            child = level.select("id", "_p", F.explode(F.array_distinct("lineage")).alias("_parent"))
            joined = active.join(parents, "qid").join(child, "_parent")
            dist = G.poincare_distance(F.col("embedding"), F.col("_p"), kappa)
            pairs = joined.select("qid", "id", dist.alias("dist")).withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= k)
        found.append(pairs.select("qid", "id", "dist"))
        parents = pairs.where("rk = 1").select("qid", F.col("id").alias("_parent"))
    if not found:
        return _results(queries, geodesic_knn(queries, prototypes, k, kappa), prototypes, kappa)
    merged = reduce(DataFrame.unionByName, found).withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= k)
    return _results(queries, merged, prototypes, kappa)


def scored(placements: DataFrame) -> DataFrame:
    """Add the placement score of the best candidate."""
    score = C.nonconformity(F.col("best_distance"), F.col("margin"), F.col("atlas_r"), C.rho_of(F.col("rank")))
    return placements.withColumn("score", F.when(F.col("taxon_id").isNotNull(), score))


def calibrated(placements: DataFrame, scores: DataFrame) -> DataFrame:
    """Add score, zone, prediction-set size and confidence against calibration ``scores(rank, score)``."""
    out = C.annotate(scored(placements), C.thresholds_with_defaults(scores))
    with_conf = C.p_values(out.where("score is not null"), scores)
    none = out.where("score is null").withColumn("confidence", F.lit(0.0))
    return with_conf.unionByName(none)


def summary(placements: DataFrame) -> DataFrame:
    """Counts, zones, and means and medians (of finite margins) over placements."""
    finite = F.when(F.col("margin") < F.lit(math.inf), F.col("margin"))
    near = F.when(F.col("best_distance") < F.lit(math.inf), F.col("best_distance"))
    return placements.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("zone") == "accept").alias("n_accept"),
        F.count_if(F.col("zone") == "escalate").alias("n_escalate"),
        F.count_if(F.col("zone") == "fallback").alias("n_fallback"),
        F.round(F.avg(F.when(F.col("zone") == "accept", 1.0).otherwise(0.0)), 6).alias("accept_rate"),
        F.round(F.avg(near), 6).alias("mean_distance"),
        F.round(F.percentile(near, F.lit(0.5)), 6).alias("median_distance"),
        F.round(F.avg(finite), 6).alias("mean_margin"),
        F.round(F.percentile(finite, F.lit(0.5)), 6).alias("median_margin"),
    )
