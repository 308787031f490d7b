"""Projection and layout for viewing: tangent PCA, monotone radii, rank bands, level of detail, labels and arcs."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from horocycle.functions import geometry as G
from horocycle.functions import numeric as N
from horocycle.functions.constants import KAPPA, RANKS


def _moments(kappa: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, None, None
        for batch in batches:
            z = np.array(batch.column(0).to_pylist(), float)
            if not len(z):
                continue
            v = N.log0(z, kappa)
            n += len(v)
            total = v.sum(0) if total is None else total + v.sum(0)
            square = v.T @ v if square is None else square + v.T @ v
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()]), pa.array([square.ravel().tolist()])], names=["n", "total", "square"])

    return run


def fit_pca(points: DataFrame, n_components: int = 2, kappa: float = KAPPA) -> dict:
    """Components, mean and explained shares of the tangent vectors at the origin of ``points(embedding)``.

    Partitions send their moments (dim squared numbers each); the sign of a component makes its largest loading positive.
    """
    rows = points.select(F.col("embedding").cast("array<double>")).mapInArrow(_moments(kappa), "n long, total array<double>, square array<double>").collect()
    if not rows:
        return {"components": np.zeros((n_components, 0)), "mean": np.zeros(0), "explained": np.zeros(n_components), "n": 0}
    n = sum(r["n"] for r in rows)
    total = np.sum([r["total"] for r in rows], axis=0)
    dim = len(total)
    cov = np.sum([r["square"] for r in rows], axis=0).reshape(dim, dim) - np.outer(total, total) / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:n_components]
    comps = vectors[:, order].T
    comps = comps * np.sign(comps[np.arange(len(comps)), np.abs(comps).argmax(1)])[:, None]
    whole = max(values.sum(), 0.0)
    flat = n == 1 or whole < 1e-15
    return {"components": np.eye(n_components, dim) if flat else comps, "mean": total / n, "explained": np.zeros(n_components) if flat else values[order] / whole, "n": n, "flat": flat}


def project(points: DataFrame, fit: dict, kappa: float = KAPPA) -> DataFrame:
    """Add ``coords``: tangent vectors on the fitted components, back on the ball."""
    comps, mean = fit["components"].tolist(), fit["mean"].tolist()
    row = lambda p: F.array(*(F.lit(float(v)) for v in p))
    centred = F.zip_with(G.log_map_0(F.col("embedding"), kappa), row(mean), lambda a, b: a - b)
    out = points.withColumn("_c", centred)
    flat = F.array(*([F.lit(0.0)] * len(comps)))
    coords = flat if fit.get("flat") else G.exp_map_0(F.array(*(G.dot(F.col("_c"), row(c)) for c in comps)), kappa)
    return out.withColumn("coords", coords).drop("_c")


def monotone_radii(points: DataFrame, by: str = "tree_id", kappa: float = KAPPA) -> DataFrame:
    """Scale ``coords`` so that along the original radius ``r0`` the projected radius never falls; factors stay in 0.5 to 2."""
    r2 = G.norm(F.col("coords"))
    order = Window.partitionBy(by).orderBy("r0", "id").rowsBetween(Window.unboundedPreceding, 0)
    out = points.withColumn("_r", r2).withColumn("_top", F.max("_r").over(order))
    factor = F.when(F.col("_r") <= 1e-10, 1.0).otherwise(F.least(F.lit(2.0), F.greatest(F.lit(0.5), F.col("_top") / F.col("_r"))))
    return out.withColumn("coords", G.clamp_to_ball(G.scaled(F.col("coords"), factor), kappa)).drop("_r", "_top")


def rank_radii(points: DataFrame) -> DataFrame:
    """``rank, radius, n``: the lower median geodesic radius of ``points(rank, r)``."""
    return points.groupBy("rank").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY r)").alias("radius"), F.count("*").alias("n"))


def bands(radii: DataFrame, kappa: float = KAPPA) -> DataFrame:
    """Rank bands from the inside out, with their Euclidean radius."""
    return radii.withColumn("euclidean_radius", G.band_radius(F.col("radius"), kappa)).orderBy("radius")


def even_radii(r_max: float) -> list[float]:
    """Radii of the seven ranks where none are known."""
    return [r_max * (r.rank + 1) / 8 for r in RANKS]


def visible(points: DataFrame, most: int) -> DataFrame:
    """The ``most`` points of ``points(id, rank, dist, ordinal)`` that matter most (coarse ranks, near the centre), in their order."""
    weight = (6 - F.col("rank")) * 10 - F.col("dist")
    return points.withColumn("_w", weight).orderBy(F.desc("_w"), "id").limit(most).drop("_w").orderBy("ordinal")


def place_labels(points: list[tuple[str, float, float, float]], separation: float = 0.05, most: int = 40) -> list[str]:
    """Names of labels that are shown: (name, x, y, weight) by weight, each at least ``separation`` from those before."""
    shown: list[tuple[str, float, float]] = []
    for name, x, y, _ in sorted(points, key=lambda p: (-p[3], p[0])):
        if len(shown) >= most:
            break
        if all(math.hypot(x - a, y - b) >= separation for _, a, b in shown):
            shown.append((name, x, y))
    return [s[0] for s in shown]


def arcs(pairs: DataFrame, n: int = 30, kappa: float = KAPPA) -> DataFrame:
    """``n`` points along each geodesic of ``pairs(id, x, y)``: ``id, step, point``."""
    t = F.col("step") / float(max(1, n - 1))
    return pairs.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("id", "step", G.geodesic_interpolation(F.col("x"), F.col("y"), t, kappa).alias("point"))
