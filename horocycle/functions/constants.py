"""Constants of the data model: curvature, taxonomic ranks, and the per-rank weights and thresholds."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

KAPPA = 1.25
BOUNDARY_EPS = 1e-5
KAPPA_FUNCTIONAL, KAPPA_PHYLOGENETIC = 1.0, 1.2475
WINDOW, STRIDE, MIN_WINDOW = 1000, 500, 200
TOP_K = 5


class Rank(NamedTuple):
    """What holds for one taxonomic rank."""

    rank: int
    name: str
    prefix: str
    rho: float
    q_accept: float
    q_fallback: float
    hplg_rho: float
    hplg_zeta: float
    hplg_accept: float
    hplg_fallback: float
    momentum: float
    min_obs: int


# Default weights, thresholds, momenta and least counts by rank.
RANKS = [
    Rank(0, "domain", "d__", 0.05, 0.8, 2.0, 0.1, 1.0, 0.30, 0.80, 0.90, 2),
    Rank(1, "phylum", "p__", 0.08, 1.0, 2.5, 0.2, 1.1, 0.35, 0.85, 0.92, 3),
    Rank(2, "class", "c__", 0.10, 1.2, 3.0, 0.2, 1.1, 0.40, 0.90, 0.93, 3),
    Rank(3, "order", "o__", 0.12, 1.4, 3.5, 0.25, 1.2, 0.45, 0.95, 0.95, 5),
    Rank(4, "family", "f__", 0.15, 1.6, 4.0, 0.25, 1.2, 0.50, 1.0, 0.95, 5),
    Rank(5, "genus", "g__", 0.20, 2.0, 5.0, 0.3, 1.2, 0.60, 1.2, 0.97, 10),
    Rank(6, "species", "s__", 0.25, 2.5, 6.0, 0.3, 1.3, 0.70, 1.5, 0.99, 20),
]
RANK_NAMES = [r.name for r in RANKS]


def rank_of(name: str) -> int:
    """The number of a rank by its name, whatever its case; ValueError for others."""
    return RANK_NAMES.index(name.strip().lower())


def ranks_table(spark: SparkSession) -> DataFrame:
    """The seven ranks as a table, which the driver holds: rows of a Python list would start Python workers on every executor."""
    rows = ", ".join("(" + ", ".join(f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else repr(x) for x in r) + ")" for r in RANKS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS ranks({', '.join(Rank._fields)})")
