"""Tables of the registered queries, derived from the given ones, and the same as DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from horocycle.functions.constants import RANKS

CODES = "".join("ACGT"[i % 4] for i in range(26)) * 2
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, label, embedding``: the given unit vectors, scaled into the ball to radii that differ."""
    factor = (F.lit(0.3) + F.lit(0.6) * (F.col("vec_id") % 97) / F.lit(97.0)) * F.lit(0.7 / math.sqrt(1.25))
    z = F.transform("embedding", lambda x: x.cast("double") * factor)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", z.alias("embedding"))


def queries_of(p: DataFrame) -> DataFrame:
    return p.where("id % 5 = 0").select(F.col("id").alias("qid"), "embedding")


def prototypes_of(p: DataFrame) -> DataFrame:
    return p.where("id % 5 <> 0")


def lineage() -> Column:
    """Seven ids from the label and the id; each level determines the one above it."""
    c = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))
    label, vid = F.col("label"), F.col("id")
    return F.array(
        c("d__D", label % 2), c("p__P", label % 4), c("c__C", label % 4), c("o__O", label % 8), c("f__F", label), c("g__G", label, "_", vid % 3), c("s__S", label, "_", vid % 9)
    )


def centroids(p: DataFrame) -> DataFrame:
    """``id, rank, lineage, embedding``: one prototype per taxon of every rank, the plain mean of its points (which lies in the ball).

    Taxa of the same points (a phylum and its only class) have the same mean to the last bit, so that their ties go by id: values are
    added as whole numbers of 2**-31 and of 2**-62, whose sums do not depend on the order.
    """
    unit = F.lit(float(1 << 31))
    high = F.floor(F.col("x") * unit)
    rows = p.select(lineage().alias("lineage"), F.posexplode("embedding").alias("k", "x"))
    rows = rows.select("lineage", "k", high.alias("h"), F.round((F.col("x") * unit - high) * unit).cast("long").alias("l"))
    sums = [F.sum("h").alias("h"), F.sum("l").alias("l")]
    rows = rows.groupBy("lineage", "k").agg(*sums, F.count("h").alias("n")).withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(6))))
    rows = rows.select("rank", F.get("lineage", F.col("rank")).alias("id"), F.slice("lineage", 1, F.col("rank") + 1).alias("lineage"), "k", "h", "l", "n")
    total = rows.groupBy("rank", "id", "lineage", "k").agg(*sums, F.sum("n").alias("n"))
    mean = total.withColumn("x", (F.col("h") / unit + F.col("l") / unit / unit) / F.col("n"))
    return mean.groupBy("rank", "id", "lineage").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("embedding"))


def taxa(p: DataFrame) -> DataFrame:
    """``taxon_id, rank, name, parent_id`` of the lineages."""
    rows = p.select(F.posexplode(lineage()).alias("rank", "taxon_id"), lineage().alias("l"))
    return rows.select("taxon_id", "rank", F.expr("substring(taxon_id, 4)").alias("name"), F.when(F.col("rank") > 0, F.get("l", F.col("rank") - 1)).alias("parent_id")).distinct()


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sequence_id, sequence``: texts spelt in four letters."""
    seq = F.regexp_replace(F.translate("text", LETTERS, CODES), "[^ACGT]", "")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sequence_id"), seq.alias("sequence"))


def history(spark: SparkSession, steps: int = 200) -> DataFrame:
    step = F.col("id").cast("int")
    return spark.range(steps).select(F.lit("run").alias("run"), step.alias("step"), (F.lit(1.0) + F.lit(0.2475) * F.least(F.lit(1.0), step / F.lit(80.0))).alias("kappa"))


# ---- the same in DuckDB

P = """pts AS (
  SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE * ((0.3::DOUBLE + 0.6::DOUBLE * (vec_id % 97) / 97.0::DOUBLE) * (0.7::DOUBLE / sqrt(1.25::DOUBLE)))) AS z FROM embeddings
), p AS (SELECT *, list_inner_product(z, z) AS nz FROM pts)"""


def dist(a: str, b: str, na: str | None = None, nb: str | None = None) -> str:
    na, nb = na or f"list_inner_product({a}, {a})", nb or f"list_inner_product({b}, {b})"
    return (
        f"(2 / sqrt(1.25::DOUBLE) * asinh(sqrt(1.25::DOUBLE) * sqrt(greatest(pow(list_distance({a}, {b}), 2), 1e-15::DOUBLE))"
        f" / sqrt(greatest((1 - 1.25::DOUBLE * {na}) * (1 - 1.25::DOUBLE * {nb}), 1e-8::DOUBLE))))"
    )


def radius(z: str) -> str:
    return f"(2 / sqrt(1.25::DOUBLE) * atanh(sqrt(1.25::DOUBLE) * least(greatest(sqrt(list_inner_product({z}, {z})), 1e-15::DOUBLE), 1 / sqrt(1.25::DOUBLE) - 1e-7::DOUBLE)))"


KNN = P + f""", pairs AS (
  SELECT q.id AS qid, x.id AS id, {dist('q.z', 'x.z', 'q.nz', 'x.nz')} AS dist FROM p q JOIN p x ON q.id % 5 = 0 AND x.id % 5 <> 0
), knn AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, id)::INTEGER AS rk FROM pairs) WHERE rk <= 5
)"""
def _loo(proto: str) -> str:
    return P + f""", proto AS (SELECT * FROM p{proto}), loo AS (
  SELECT * FROM (SELECT a.id AS id, {dist('a.z', 'b.z', 'a.nz', 'b.nz')} AS dist, row_number() OVER (PARTITION BY a.id ORDER BY {dist('a.z', 'b.z', 'a.nz', 'b.nz')}, b.id) AS rk
  FROM proto a JOIN proto b ON a.id <> b.id) WHERE rk <= 5
), field AS (SELECT id, count(*) / sum(1 / greatest(dist, 1e-15::DOUBLE)) AS sigma FROM loo GROUP BY id)"""


#: Leave-one-out neighbours of all points, and of the prototypes alone (where the other points are queries).
LOO, LOO_SPLIT = _loo(""), _loo(" WHERE id % 5 <> 0")
#: Up to 1000 quartets of all points, drawn as ``tree.hashed_quartets`` draws them.
QUARTETS = """ord AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM p), n AS (SELECT count(*) AS n FROM p), draw AS (
  SELECT DISTINCT list_sort(list_distinct(list_transform([0, 1, 2, 3], lambda k: ('0x' || substr(md5('42:' || s || ':' || k), 1, 8))::BIGINT % n))) AS q FROM range(0, 1000) t(s) CROSS JOIN n
), quartets AS (SELECT a.id AS a, b.id AS b, c.id AS c, d.id AS d FROM draw JOIN ord a ON a.i = q[1] JOIN ord b ON b.i = q[2] JOIN ord c ON c.i = q[3] JOIN ord d ON d.i = q[4] WHERE len(q) = 4)"""
LINEAGE = (
    "['d__D' || (label % 2), 'p__P' || (label % 4), 'c__C' || (label % 4), 'o__O' || (label % 8), 'f__F' || label, 'g__G' || label || '_' || (id % 3), 's__S' || label || '_' || (id % 9)]"
)
CENTROIDS = P + f""", lin AS (SELECT z, {LINEAGE} AS l FROM p), ranks AS (SELECT unnest(range(1, 8)) AS r), comp AS (
  SELECT r - 1 AS rank, l[r] AS id, list_slice(l, 1, r) AS lineage, k, avg(z[k]) AS x
  FROM lin CROSS JOIN ranks CROSS JOIN (SELECT unnest(range(1, 65)) AS k) GROUP BY ALL
), cen AS (SELECT rank::INTEGER AS rank, id, lineage, list(x ORDER BY k) AS z FROM comp GROUP BY rank, id, lineage)"""
TAXA = P + f""", taxa AS (
  SELECT DISTINCT l[r] AS taxon_id, (r - 1)::INTEGER AS rank, substr(l[r], 4) AS name, CASE WHEN r > 1 THEN l[r - 1] END AS parent_id FROM (SELECT {LINEAGE} AS l FROM p) CROSS JOIN (SELECT unnest(range(1, 8)) AS r)
)"""
DNA = f"""dna AS (SELECT doc_id AS sequence_id, regexp_replace(translate(text, '{LETTERS}', '{CODES}'), '[^ACGT]', '', 'g') AS seq FROM documents)"""
LIMITS = "limits AS (SELECT * FROM (VALUES " + ", ".join(f"({r.rank}, {r.rho}::DOUBLE, {r.q_accept}::DOUBLE, {r.q_fallback}::DOUBLE, {r.hplg_rho}::DOUBLE, {r.hplg_accept}::DOUBLE, {r.hplg_fallback}::DOUBLE)" for r in RANKS) + ") t(rank, rho, qa, qf, hrho, ha, hf))"
