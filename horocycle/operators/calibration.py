"""Rank-stratified conformal calibration: thresholds, p-values, decision zones and prediction-set sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from horocycle.functions.constants import RANKS, ranks_table

PLACE_LEAST, HPLG_LEAST, MOST_SCORES = 5, 30, 10_000


def nonconformity(dist: Column, margin: Column, r: Column, rho: Column, eta: float = 1.0) -> Column:
    """Placement score: distance less the margin (20 at most) plus the weighted radius."""
    return dist - F.lit(eta) * F.least(margin, F.lit(20.0)) + rho * r


def nonconformity_hplg(dist: Column, margin: Column, r: Column, rho: Column, zeta: Column, llr: Column | None = None, eta: float = 1.0) -> Column:
    """Hierarchical score: the margin has no cap, and a log-likelihood ratio counts if there is one."""
    base = dist - F.lit(eta) * margin + rho * r
    return base if llr is None else base - zeta * F.coalesce(llr, F.lit(0.0))


def no_scores(spark: SparkSession) -> DataFrame:
    """``rank, score`` without rows, which the optimiser knows to be empty."""
    return spark.sql("SELECT CAST(0 AS INT) AS rank, CAST(0 AS DOUBLE) AS score WHERE false")


def order_statistic(scores: DataFrame, by: str, value: str, eps: float, least: int, name: str) -> DataFrame:
    """``by, name``: the ceil((n+1)(1-eps))-th smallest value per group, for groups of at least ``least``.

    The place comes from a count per group, the value from a ranked filter, so no group is gathered in a row.
    """
    n = scores.groupBy(by).agg(F.count(value).alias("_n")).where(F.col("_n") >= least)
    place = F.least(F.ceil((F.col("_n") + 1) * F.lit(1.0 - eps)), F.col("_n")).cast("long")
    ranked = scores.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(Window.partitionBy(by).orderBy(value)))
    joined = ranked.join(F.broadcast(n.select(F.col(by).alias("_by"), F.greatest(place, F.lit(1)).alias("_at"))), F.col(by) == F.col("_by"))
    return joined.where("_i = _at").select(by, F.col(value).alias(name))


def thresholds(scores: DataFrame, by: str = "rank", value: str = "score", eps: tuple[float, float] = (0.10, 0.01), least: int = PLACE_LEAST) -> DataFrame:
    """``by, n, q_accept, q_fallback``: empirical thresholds of each group with enough scores."""
    n = scores.groupBy(by).agg(F.count(value).alias("n"))
    accept = order_statistic(scores, by, value, eps[0], least, "q_accept")
    fallback = order_statistic(scores, by, value, eps[1], least, "q_fallback")
    return n.join(accept, by, "left").join(fallback, by, "left")


def thresholds_with_defaults(scores: DataFrame, hplg: bool = False) -> DataFrame:
    """Thresholds of all seven ranks: empirical where there are enough scores, else the defaults."""
    found = thresholds(scores, "rank", "score", least=HPLG_LEAST if hplg else PLACE_LEAST)
    spark = scores.sparkSession
    a, f = ("hplg_accept", "hplg_fallback") if hplg else ("q_accept", "q_fallback")
    base = ranks_table(spark).select("rank", F.col(a).alias("_a"), F.col(f).alias("_f"))
    return base.join(found, "rank", "left").select(
        "rank", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("q_accept", "_a").alias("q_accept"), F.coalesce("q_fallback", "_f").alias("q_fallback"), F.col("q_accept").isNotNull().alias("calibrated")
    )


def zone(score: Column, q_accept: Column, q_fallback: Column, hplg: bool = False) -> Column:
    """accept, escalate or fallback; an inverted pair is swapped (placement) or closed (hierarchical)."""
    low = q_accept if hplg else F.least(q_accept, q_fallback)
    high = F.greatest(q_accept, q_fallback)
    return F.when(score <= low, "accept").when(score <= high, "escalate").otherwise("fallback")


def prediction_set_size(score: Column, q_accept: Column, q_fallback: Column, n: Column) -> Column:
    low, high = F.least(q_accept, q_fallback), F.greatest(q_accept, q_fallback)
    width = high - low
    inside = F.when(n == 0, 3).when(width <= 0, 2).otherwise(F.greatest(F.lit(2), F.floor(2 + 8 * (score - low) / width).cast("int")))
    return F.when(score <= low, 1).when(score > high, -1).otherwise(inside).cast("int")


def heuristic_confidence(score: Column) -> Column:
    return 1 / (1 + F.exp(score))


def p_values(queries: DataFrame, scores: DataFrame, by: str = "rank", least: int = PLACE_LEAST) -> DataFrame:
    """Add ``confidence`` to ``queries(by, score)``: the share (of n + 1) of its group's scores that are no smaller.

    Both sides are sorted together per group and a running count does the rest; groups of few scores get the heuristic one.
    """
    tagged = queries.withColumn("_cal", F.lit(0))
    both = tagged.unionByName(scores.select(by, "score").withColumn("_cal", F.lit(1)), allowMissingColumns=True)
    above = Window.partitionBy(by).orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_ge", F.sum("_cal").over(above)).withColumn("_n", F.sum("_cal").over(Window.partitionBy(by)))
    conf = F.when(F.col("_n") < least, heuristic_confidence(F.col("score"))).otherwise(F.col("_ge") / (F.col("_n") + 1))
    return both.where("_cal = 0").withColumn("confidence", conf).drop("_cal", "_ge", "_n")


def annotate(placements: DataFrame, limits: DataFrame) -> DataFrame:
    """Add ``zone, prediction_set_size`` to ``placements(score, rank)`` by the thresholds of ``limits``; no candidate: fallback."""
    limit = F.broadcast(limits.select("rank", "n", "q_accept", "q_fallback"))
    out = placements.join(limit, "rank", "left")
    decided = zone(F.col("score"), F.col("q_accept"), F.col("q_fallback"))
    return (
        out.withColumn("zone", F.when(F.col("score").isNull(), "fallback").otherwise(decided))
        .withColumn("prediction_set_size", F.when(F.col("score").isNull(), -1).otherwise(prediction_set_size(F.col("score"), F.col("q_accept"), F.col("q_fallback"), F.col("n"))))
        .drop("n", "q_accept", "q_fallback")
    )


def bounded_scores(scores: DataFrame, id_col: str, most: int = MOST_SCORES, seed: int = 0) -> DataFrame:
    """At most ``most`` scores per rank: those of the smallest hashes of their ids, the same ones every time."""
    order = Window.partitionBy("rank").orderBy(F.xxhash64(id_col, F.lit(seed)), id_col)
    return scores.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= most).drop("_i")


def summary(scores: DataFrame, hplg: bool = True) -> DataFrame:
    """Per rank: number of scores, whether calibrated, rounded thresholds and the width between them."""
    t = thresholds_with_defaults(scores, hplg)
    return t.select("rank", "n", "calibrated", F.round("q_accept", 4).alias("q_accept"), F.round("q_fallback", 4).alias("q_fallback"), F.round(F.col("q_fallback") - F.col("q_accept"), 4).alias("escalation_width"))


def rho_of(rank: Column, hplg: bool = False) -> Column:
    out = F.lit(0.3 if hplg else 0.1)
    for r in RANKS:
        out = F.when(rank == r.rank, r.hplg_rho if hplg else r.rho).otherwise(out)
    return out
