"""Novelty, uncertainty fields, dark maps and triage: what is far from, or badly surrounded by, the prototypes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from horocycle.functions.constants import KAPPA
from horocycle.operators.knn import geodesic_knn, geodesic_others

SIGMA_K, NOVEL_QUANTILE, DARK_QUANTILE = 5, 0.99, 0.95


def loo_nearest(prototypes: DataFrame, kappa: float = KAPPA) -> DataFrame:
    """``id, dist``: the distance of each prototype to its nearest other one."""
    return geodesic_others(prototypes, 1, kappa).select(F.col("qid").alias("id"), "dist")


def novelty_threshold(prototypes: DataFrame, q: float = NOVEL_QUANTILE, kappa: float = KAPPA) -> DataFrame:
    """One row ``threshold``: a quantile of the leave-one-out distances; 0 for fewer than two prototypes."""
    found = loo_nearest(prototypes, kappa)
    return found.agg(F.coalesce(F.percentile("dist", F.lit(q)), F.lit(0.0)).alias("threshold"))


def novelty(queries: DataFrame, prototypes: DataFrame, threshold: DataFrame, k: int = 5, kappa: float = KAPPA) -> DataFrame:
    """``qid, nearest_id, nearest_distance, threshold, is_novel, top_ids, top_distances``; never novel without a threshold."""
    found = geodesic_knn(queries, prototypes, max(1, k), kappa)
    top = F.sort_array(F.collect_list(F.struct("rk", "id", "dist")))
    rows = found.groupBy("qid").agg(F.min_by("id", "rk").alias("nearest_id"), F.min("dist").alias("nearest_distance"), top.alias("_t"))
    rows = rows.crossJoin(F.broadcast(threshold.limit(1)))
    return rows.select(
        "qid", "nearest_id", "nearest_distance", "threshold", F.coalesce(F.col("nearest_distance") > F.col("threshold"), F.lit(False)).alias("is_novel"),
        F.transform("_t", lambda x: x["id"]).alias("top_ids"), F.transform("_t", lambda x: x["dist"]).alias("top_distances"),
    )


def _harmonic(found: DataFrame) -> DataFrame:
    return found.groupBy("qid").agg((F.count("*") / F.sum(1 / F.greatest("dist", F.lit(1e-15)))).alias("sigma"))


def sigma(queries: DataFrame, prototypes: DataFrame, k: int = SIGMA_K, kappa: float = KAPPA) -> DataFrame:
    """``qid, sigma``: the harmonic mean distance to the k nearest prototypes."""
    return _harmonic(geodesic_knn(queries, prototypes, k, kappa))


def sigma_field(prototypes: DataFrame, k: int = SIGMA_K, kappa: float = KAPPA) -> DataFrame:
    """``id, sigma`` of each prototype among the others; 0 for a single one."""
    found = _harmonic(geodesic_others(prototypes, k, kappa)).withColumnRenamed("qid", "id")
    return prototypes.select("id").join(found, "id", "left").select("id", F.coalesce("sigma", F.lit(0.0)).alias("sigma"))


def field_stats(field: DataFrame) -> DataFrame:
    """Mean, lower median, sample deviation, interpolated quantiles and number of sigmas."""
    return field.agg(
        F.round(F.avg("sigma"), 6).alias("mean"),
        F.round(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY sigma)"), 6).alias("median"),
        F.round(F.coalesce(F.stddev_samp("sigma"), F.lit(0.0)), 6).alias("std"),
        F.round(F.percentile("sigma", F.lit(0.95)), 6).alias("q95"),
        F.round(F.percentile("sigma", F.lit(0.99)), 6).alias("q99"),
        F.count("*").alias("n"),
    )


def dark_map(field: DataFrame, q: float = DARK_QUANTILE) -> DataFrame:
    """``id, sigma, is_dark``: dark are those above the quantile of the field."""
    cut = field.agg(F.percentile("sigma", F.lit(q)).alias("_cut"))
    return field.crossJoin(F.broadcast(cut)).select("id", "sigma", (F.col("sigma") > F.col("_cut")).alias("is_dark"))


def dark_summary(dark: DataFrame) -> DataFrame:
    is_dark = F.col("is_dark")
    return dark.agg(
        F.count_if(is_dark).alias("n_dark"),
        F.count_if(~is_dark).alias("n_charted"),
        F.round(100.0 * F.avg(F.when(is_dark, 1.0).otherwise(0.0)), 6).alias("pct_dark"),
        F.round(F.avg(F.when(is_dark, F.col("sigma"))), 6).alias("mean_sigma_dark"),
        F.round(F.avg(F.when(~is_dark, F.col("sigma"))), 6).alias("mean_sigma_charted"),
        F.round(F.max(F.when(is_dark, F.col("sigma"))), 6).alias("max_sigma_dark"),
        F.round(F.max(F.when(~is_dark, F.col("sigma"))), 6).alias("max_sigma_charted"),
    )


def triage(queries: DataFrame, prototypes: DataFrame, field: DataFrame, k: int = SIGMA_K, kappa: float = KAPPA) -> DataFrame:
    """``qid, nearest_id, nearest_distance, sigma, epsilon, sigma_threshold, category`` of each query.

    Nearer than the field's lower median: redundant; else novel, certain up to the field's 0.95 quantile of sigma.
    """
    found = geodesic_knn(queries, prototypes, k, kappa)
    rows = found.groupBy("qid").agg(
        F.min_by("id", "rk").alias("nearest_id"), F.min("dist").alias("nearest_distance"), (F.count("*") / F.sum(1 / F.greatest("dist", F.lit(1e-15)))).alias("sigma")
    )
    limits = field.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY sigma)").alias("epsilon"), F.percentile("sigma", F.lit(0.95)).alias("sigma_threshold"))
    category = F.when(F.col("nearest_distance") < F.col("epsilon"), "redundant").when(F.col("sigma") <= F.col("sigma_threshold"), "novel_certain").otherwise("novel_uncertain")
    return rows.crossJoin(F.broadcast(limits)).withColumn("category", category)


def triage_counts(triaged: DataFrame) -> DataFrame:
    return triaged.groupBy("category").agg(F.count("*").alias("n"))
