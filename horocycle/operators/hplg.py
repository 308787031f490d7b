"""Hierarchical classification down a taxonomy, the taxonomy itself, prototype banks and the curvature monitor."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from horocycle.functions import geometry as G
from horocycle.functions import numeric as N
from horocycle.functions.constants import KAPPA, KAPPA_FUNCTIONAL, KAPPA_PHYLOGENETIC, RANK_NAMES, RANKS, ranks_table
from horocycle.operators import calibration as C

# ---- taxonomy: edges (taxon_id, rank, name, parent_id)


def taxonomy_from_lineages(lineages: DataFrame) -> DataFrame:
    """``taxon_id, rank, name, parent_id`` from ``lineages(lineage array<struct<rank string, name string>>)``; unknown ranks are skipped."""
    names = {n: i for i, n in enumerate(RANK_NAMES)}
    number = lambda x: reduce(lambda acc, n: F.when(F.lower(x["rank"]) == n, names[n]).otherwise(acc), names, F.lit(None).cast("int"))
    known = F.filter("lineage", lambda x: number(x).isNotNull() & (F.length(x["name"]) > 0))
    ident = lambda x: F.concat(F.substring(F.lower(x["rank"]), 1, 1), F.lit("__"), x["name"])
    rows = lineages.select(F.posexplode(F.transform(known, lambda x, i: F.struct(ident(x).alias("taxon_id"), number(x).alias("rank"), x["name"].alias("name"), F.when(i > 0, ident(F.get(known, i - 1))).alias("parent_id")))).alias("i", "t"))
    return rows.select("t.*").groupBy("taxon_id").agg(F.min("rank").alias("rank"), F.min("name").alias("name"), F.min("parent_id").alias("parent_id"))


def descendants(taxa: DataFrame) -> DataFrame:
    """``ancestor_id, taxon_id, rank``: the closure, by at most as many joins as there are ranks."""
    step = taxa.where("parent_id is not null").select(F.col("parent_id").alias("ancestor_id"), "taxon_id", "rank")
    level, out = step, [step]
    up = taxa.where("parent_id is not null").select(F.col("taxon_id").alias("ancestor_id"), F.col("parent_id").alias("_up"))
    for _ in range(len(RANKS) - 2):
        level = level.join(up, "ancestor_id").select(F.col("_up").alias("ancestor_id"), "taxon_id", "rank")
        out.append(level)
    return reduce(DataFrame.unionByName, out).distinct()


def lineage_of(taxa: DataFrame) -> DataFrame:
    """``taxon_id, lineage``: the path from the root, by parent pointers."""
    all_of = descendants(taxa).unionByName(taxa.select(F.col("taxon_id").alias("ancestor_id"), "taxon_id", "rank"))
    ranked = all_of.join(taxa.select(F.col("taxon_id").alias("ancestor_id"), F.col("rank").alias("_r")), "ancestor_id")
    return ranked.groupBy("taxon_id").agg(F.transform(F.sort_array(F.collect_set(F.struct("_r", "ancestor_id"))), lambda x: x["ancestor_id"]).alias("lineage"))


def rank_sizes(taxa: DataFrame) -> DataFrame:
    """``rank, n`` for all seven ranks, zeros included."""
    n = taxa.groupBy("rank").agg(F.count("*").alias("n"))
    return ranks_table(taxa.sparkSession).select("rank").join(n, "rank", "left").select("rank", F.coalesce("n", F.lit(0)).alias("n"))


# ---- frozen descent


def classify(queries: DataFrame, prototypes: DataFrame, taxa: DataFrame, limits: DataFrame | None = None, scale: float = 1.0, llr: DataFrame | None = None, kappa: float = KAPPA) -> DataFrame:
    """Decisions ``qid, rank, taxon_id, distance, margin, score, zone, confidence, used_llr`` of ``queries(qid, embedding)``.

    At each rank the candidates are the prototypes below the last accepted taxon (all at the first rank).  The best one's score
    decides by the rank's thresholds (``limits(rank, q_accept, q_fallback)``, defaults otherwise) times ``scale``: accept and go on,
    or fall back and stop; between the two, ``llr(qid, taxon_id, delta_llr)`` of the best can turn it into an acceptance.
    Thresholds and prototypes stay as they are.
    """
    spark = queries.sparkSession
    table = limits if limits is not None else ranks_table(spark).select("rank", F.col("hplg_accept").alias("q_accept"), F.col("hplg_fallback").alias("q_fallback"))
    cut = {r["rank"]: (r["q_accept"], r["q_fallback"]) for r in table.collect()}
    closure = descendants(taxa)
    order = Window.partitionBy("qid").orderBy("distance", "taxon_id")
    active, out = queries.select("qid", "embedding", F.lit(None).cast("string").alias("parent")), []
    for r in RANKS:
        level = prototypes.where(F.col("rank") == r.rank).select(F.col("id").alias("taxon_id"), F.col("embedding").alias("_p"))
        if r.rank == 0:
            pairs = active.crossJoin(level)
        else:
            below = closure.where(F.col("rank") == r.rank).select(F.col("ancestor_id").alias("parent"), "taxon_id")
            pairs = active.join(below, "parent").join(level, "taxon_id")
        pairs = pairs.select("qid", "embedding", "taxon_id", G.poincare_distance(F.col("embedding"), F.col("_p"), kappa).alias("distance"))
        two = pairs.withColumn("_i", F.row_number().over(order)).where("_i <= 2")
        best = two.groupBy("qid").agg(
            F.min_by("taxon_id", "_i").alias("taxon_id"), F.min("distance").alias("distance"), F.max("distance").alias("_second"), F.count("*").alias("_n"), F.min_by("embedding", "_i").alias("embedding")
        )
        margin = F.when(F.col("_n") > 1, F.col("_second") - F.col("distance")).otherwise(F.lit(1.0))
        best = best.withColumn("margin", margin)
        accept, fallback = (x * scale for x in cut[r.rank])
        radius = G.dist_from_origin(F.col("embedding"), kappa)
        plain = C.nonconformity_hplg(F.col("distance"), F.col("margin"), radius, F.lit(r.hplg_rho), F.lit(r.hplg_zeta))
        best = best.withColumn("score", plain)
        best = best.join(llr, ["qid", "taxon_id"], "left") if llr is not None else best.withColumn("delta_llr", F.lit(None).cast("double"))
        first = C.zone(F.col("score"), F.lit(accept), F.lit(fallback), hplg=True)
        used = (first == "escalate") & F.col("delta_llr").isNotNull()
        again = F.col("score") - F.lit(r.hplg_zeta) * F.col("delta_llr")
        final = F.when(first == "escalate", F.when(used & (again <= accept), "accept").otherwise("fallback")).otherwise(first)
        conf = F.greatest(F.lit(0.0), 1 - F.col("score") / fallback) if fallback > 0 else F.lit(0.0)
        best = best.select("qid", "embedding", F.lit(r.rank).alias("rank"), "taxon_id", "distance", "margin", "score", final.alias("zone"), conf.alias("confidence"), used.alias("used_llr"))
        out.append(best.drop("embedding"))
        active = best.where("zone = 'accept'").select("qid", "embedding", F.col("taxon_id").alias("parent"))
    return reduce(DataFrame.unionByName, out)


def results(queries: DataFrame, decisions: DataFrame) -> DataFrame:
    """``qid, final_rank, final_taxon, lineage, n_decisions``: the deepest acceptance and the accepted path."""
    ok = F.col("zone") == "accept"
    path = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(ok, F.struct("rank", "taxon_id")))), lambda x: x["taxon_id"]), ";")
    found = decisions.groupBy("qid").agg(
        F.max(F.when(ok, F.col("rank"))).alias("final_rank"), F.max_by("taxon_id", F.when(ok, F.col("rank"))).alias("final_taxon"), path.alias("lineage"), F.count("*").alias("n_decisions")
    )
    return queries.select("qid").join(found, "qid", "left")


def stats(decisions: DataFrame) -> DataFrame:
    """``rank, n, accept_rate, fallback_rate, n_llr, mean_confidence`` per rank reached."""
    share = lambda z: F.round(F.avg(F.when(F.col("zone") == z, 1.0).otherwise(0.0)), 6)
    return decisions.groupBy("rank").agg(
        F.count("*").alias("n"), share("accept").alias("accept_rate"), share("fallback").alias("fallback_rate"), F.count_if("used_llr").alias("n_llr"), F.round(F.avg("confidence"), 6).alias("mean_confidence")
    )


# ---- prototype banks


def bank_from(points: DataFrame, kappa: float = KAPPA) -> DataFrame:
    """``taxon_id, rank, student, teacher, observation_count, teacher_count`` from raw ``points(taxon_id, rank, embedding)``."""
    from horocycle.operators.reference import karcher_means

    rank = points.groupBy("taxon_id").agg(F.min("rank").alias("rank"))
    z = karcher_means(points.select("taxon_id", "embedding"), "taxon_id", kappa).withColumn("embedding", G.clamp_to_ball(F.col("embedding"), kappa))
    return z.join(rank, "taxon_id").select("taxon_id", "rank", F.col("embedding").alias("student"), F.col("embedding").alias("teacher"), F.lit(0).cast("long").alias("observation_count"), F.lit(0).cast("long").alias("teacher_count"))


def momentum_of(rank: int) -> float:
    return RANKS[rank].momentum if 0 <= rank < len(RANKS) else 0.95


def ema_step(student: np.ndarray, teacher: np.ndarray, teacher_count: int, x: np.ndarray, momentum: float, kappa: float = KAPPA) -> tuple[np.ndarray, bool]:
    """One guarded student update: (student, whether it was taken)."""
    x = N.clamp(x, kappa)
    if teacher_count > 0:
        far = float(N.distance(x, teacher, kappa))
        if far > max(3.0 * float(N.distance(student, teacher, kappa)), 0.5):
            return student, False
    return N.clamp(N.interpolate(student, x, 1 - momentum, kappa), kappa), True


def ema_update(bank: DataFrame, observations: DataFrame, scale: float = 1.0, kappa: float = KAPPA) -> DataFrame:
    """Fold ``observations(taxon_id, ordinal, embedding)`` into the students, in order and per taxon."""
    obs = observations.select("taxon_id", "ordinal", "embedding")

    def fold(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return left
        row = left.iloc[0]
        student, teacher = np.asarray(row["student"], float), np.asarray(row["teacher"], float)
        n, step = int(row["observation_count"]), momentum_of(int(row["rank"])) * scale
        for x in right.sort_values("ordinal")["embedding"]:
            student, taken = ema_step(student, teacher, int(row["teacher_count"]), np.asarray(x, float), step, kappa)
            n += taken
        out = left.head(1).copy()
        out["student"], out["observation_count"] = [student.tolist()], [n]
        return out

    return bank.groupBy("taxon_id").cogroup(obs.groupBy("taxon_id")).applyInPandas(fold, bank.schema)


def reanchor(bank: DataFrame, t: float = 0.1, kappa: float = KAPPA) -> DataFrame:
    """Move students towards their teachers."""
    moved = G.geodesic_interpolation(F.col("student"), F.col("teacher"), F.lit(t), kappa)
    return bank.withColumn("student", moved)


def freeze(bank: DataFrame) -> DataFrame:
    """Make the students the teachers."""
    return bank.withColumn("teacher", F.col("student")).withColumn("teacher_count", F.col("observation_count"))


def reliable(bank: DataFrame) -> DataFrame:
    """Whether a prototype has its rank's least number of observations."""
    least = F.lit(10)
    for r in RANKS:
        least = F.when(F.col("rank") == r.rank, r.min_obs).otherwise(least)
    return bank.withColumn("reliable", F.col("observation_count") >= least)


# ---- curvature monitor


def curvature_states(history: DataFrame, window: int = 50, limit: float = 0.005) -> DataFrame:
    """``run, step, kappa, progress, phase, is_stable, steps_in_phase`` and the scales, for ``history(run, step, kappa)``.

    Progress runs from the functional to the phylogenetic curvature; below 0.05 and above 0.95 are phases of their own, and between
    them lies the transition.  Stable is a deviation of the last ``window`` values under ``limit``; shorter histories are stable
    while they have fewer than ten values.  The phase before the first step counts as functional.
    """
    order = Window.partitionBy("run").orderBy("step")
    progress = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("kappa") - KAPPA_FUNCTIONAL) / (KAPPA_PHYLOGENETIC - KAPPA_FUNCTIONAL)))
    out = history.withColumn("progress", progress)
    out = out.withColumn("phase", F.when(F.col("progress") < 0.05, "functional").when(F.col("progress") > 0.95, "phylogenetic").otherwise("transition"))
    n = F.row_number().over(order)
    std = F.stddev_pop("kappa").over(order.rowsBetween(1 - window, 0))
    out = out.withColumn("is_stable", F.when(n < window, n < 10).otherwise(std < limit))
    change = F.when(F.col("phase") != F.coalesce(F.lag("phase").over(order), F.lit("functional")), 1).otherwise(0)
    out = out.withColumn("_island", F.sum(change).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.row_number().over(Window.partitionBy("run", "_island").orderBy("step"))
    out = out.withColumn("steps_in_phase", F.when(F.col("_island") == 0, run).otherwise(run - 1))
    return out.drop("_island").withColumns(scales(F.col("progress"), F.col("phase"), F.col("is_stable")))


def scales(progress: Column, phase: Column, stable: Column) -> dict[str, Column]:
    unsettled = (phase == "transition") & ~stable
    return {
        "threshold_scale": 1 + 0.5 * (1 - F.abs(2 * progress - 1)),
        "momentum_scale": F.when(unsettled, 0.5).otherwise(1.0),
        "reanchor_scale": F.when(unsettled, 2.0).otherwise(1.0),
    }


# ---- online classification


def classify_online(queries: DataFrame, prototypes: DataFrame, taxa: DataFrame, kappa: float = KAPPA, stream_col: str = "stream") -> DataFrame:
    """Ordered classification that adds each acceptance's score to its rank's calibration before the next query of the stream.

    ``queries(stream, ordinal, qid, embedding)``; streams are independent of one another, one task each.
    """
    protos = [(r["id"], r["rank"], np.array(r["embedding"], float)) for r in prototypes.select("id", "rank", "embedding").toLocalIterator()]
    below: dict[str, set] = {}
    for r in descendants(taxa).toLocalIterator():
        below.setdefault(r["ancestor_id"], set()).add(r["taxon_id"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        scores: dict[int, list[float]] = {r.rank: [] for r in RANKS}
        rows = []
        for q in group.sort_values("ordinal").itertuples():
            z, parent = np.asarray(q.embedding, float), None
            radius = float(N.origin_distance(z, kappa))
            for r in RANKS:
                some = [(t, p) for t, k, p in protos if k == r.rank and (parent is None or t in below.get(parent, ()))]
                if not some:
                    break
                near = sorted((float(N.distance(z, p, kappa)), t) for t, p in some)
                margin = near[1][0] - near[0][0] if len(near) > 1 else 1.0
                score = near[0][0] - margin + r.hplg_rho * radius
                accept, fallback = r.hplg_accept, r.hplg_fallback
                own = sorted(scores[r.rank])
                if len(own) >= C.HPLG_LEAST:
                    pick = lambda e, own=own: own[min(math.ceil((len(own) + 1) * (1 - e)) - 1, len(own) - 1)]
                    accept, fallback = pick(0.10), max(pick(0.10), pick(0.01))
                zone = "accept" if score <= accept else "fallback"
                rows.append((getattr(q, stream_col), q.qid, r.rank, near[0][1], score, zone))
                if zone != "accept":
                    break
                scores[r.rank] = [*scores[r.rank], score][-C.MOST_SCORES :]
                parent = near[0][1]
        return pd.DataFrame(rows, columns=[stream_col, "qid", "rank", "taxon_id", "score", "zone"])

    kinds = dict(queries.dtypes)
    return queries.groupBy(stream_col).applyInPandas(run, f"{stream_col} {kinds[stream_col]}, qid {kinds['qid']}, rank int, taxon_id string, score double, zone string")
