"""Reference tables of prototypes: Karcher means, upserts, roll-up along lineages, children, save and load."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horocycle.functions import geometry as G
from horocycle.functions import numeric as N
from horocycle.functions.constants import KAPPA


def karcher_means(points: DataFrame, by: str, kappa: float = KAPPA) -> DataFrame:
    """``by, embedding, variance, n``: the Karcher mean of ``points(by, embedding)`` per group, weights from ``weight`` if there."""
    weighted = "weight" in points.columns

    def mean(group: pd.DataFrame) -> pd.DataFrame:
        z = np.stack(group["embedding"].to_numpy())
        mu, var = N.karcher_mean(z, kappa, weights=group["weight"].to_numpy() if weighted else None)
        return pd.DataFrame({by: [group[by].iloc[0]], "embedding": [mu.tolist()], "variance": [var], "n": [len(group)]})

    schema = f"{by} {dict(points.dtypes)[by]}, embedding array<double>, variance double, n long"
    cols = [by, F.col("embedding").cast("array<double>").alias("embedding"), *(["weight"] if weighted else [])]
    return points.select(*cols).groupBy(by).applyInPandas(mean, schema)


def upsert(prototypes: DataFrame, kappa: float = KAPPA) -> DataFrame:
    """Fold rows of one ``taxon_id`` in order of ``ordinal``: each joins the mean by its count; the first one's rank and lineage stay.

    The weighted mean of two points is the geodesic point at the later one's share of the counts.
    """

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ordinal")
        z, n = None, 0
        for e, c in zip(group["embedding"], group["observation_count"], strict=True):
            e = N.clamp(np.asarray(e, float), kappa)
            z, n = (e, int(c)) if z is None else (N.interpolate(z, e, c / (n + c), kappa), n + int(c))
        first = group.iloc[0]
        return pd.DataFrame({"taxon_id": [first["taxon_id"]], "rank": [first["rank"]], "embedding": [z.tolist()], "lineage": [list(first["lineage"])], "observation_count": [n]})

    return prototypes.groupBy("taxon_id").applyInPandas(fold, "taxon_id string, rank int, embedding array<double>, lineage array<string>, observation_count long")


def from_lineages(leaves: DataFrame, kappa: float = KAPPA) -> DataFrame:
    """Prototypes of all ranks from ``leaves(taxon_id, embedding, lineage, ordinal)``.

    The leaf rank is the lineage's length less one; equal leaf ids fold in order, and every coarser taxon is the Karcher mean of all
    raw leaf embeddings below it, with the lineage cut there.
    """
    leaves = leaves.withColumn("rank", (F.size("lineage") - 1).cast("int")).withColumn("embedding", F.col("embedding").cast("array<double>"))
    own = upsert(leaves.select("taxon_id", "rank", "embedding", "lineage", F.lit(1).cast("long").alias("observation_count"), "ordinal"), kappa)
    above = leaves.where("rank > 0").select("embedding", "lineage", F.explode(F.sequence(F.lit(0), F.col("rank") - 1)).alias("r"))
    above = above.select(F.get("lineage", F.col("r")).alias("taxon_id"), F.col("r").alias("rank"), "embedding", F.slice("lineage", 1, F.col("r") + 1).alias("lineage"))
    info = above.groupBy("taxon_id").agg(F.min("rank").alias("rank"), F.min("lineage").alias("lineage"))
    mean = karcher_means(above, "taxon_id", kappa).join(info, "taxon_id")
    return own.unionByName(mean.select("taxon_id", F.col("rank").cast("int"), "embedding", "lineage", F.col("n").alias("observation_count")))


def children(prototypes: DataFrame, parent: str, rank: int) -> DataFrame:
    """Prototypes of a rank whose lineage contains ``parent``."""
    return prototypes.where((F.col("rank") == rank) & F.array_contains("lineage", parent))


def rank_counts(prototypes: DataFrame) -> DataFrame:
    return prototypes.groupBy("rank").agg(F.count("*").alias("n"))


def save(prototypes: DataFrame, path: str, kappa: float = KAPPA) -> None:
    """Parquet by rank, so that readers of one rank touch nothing else, and a table of kappa beside it."""
    prototypes.write.mode("overwrite").partitionBy("rank").parquet(f"{path}/prototypes")
    prototypes.sparkSession.range(1).select(F.lit(kappa).alias("kappa")).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> DataFrame:
    """Prototypes saved by ``save``, pulled back into the ball."""
    kappa = spark.read.parquet(f"{path}/meta").first()["kappa"]
    found = spark.read.parquet(f"{path}/prototypes")
    return found.withColumn("embedding", G.clamp_to_ball(F.col("embedding"), kappa)).withColumn("rank", F.col("rank").cast("int"))
