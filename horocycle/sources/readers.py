"""Readers: FASTA, manifests, arrays, taxa lists, vocabularies, tree JSON, reference tables and the coordinate datum."""

from __future__ import annotations

import io
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horocycle.functions import geometry as G
from horocycle.functions import sequences as S
from horocycle.functions.constants import KAPPA


def read_fasta(spark: SparkSession, path: str, first_token: bool = False, upper: bool = True) -> DataFrame:
    """``sequence_id, sequence, file``: one row per record of FASTA files (gzip by suffix).

    Records are cut by the reader at "\\n>", so a file is split across tasks and never read whole.  Text before the first header
    is dropped; a header without a body gives an empty sequence; with ``first_token`` the id ends at white space.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"))

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Only the first record of a file still has its ">"; what stands before it belongs to no record."""
        begun: set[str] = set()
        for batch in batches:
            files, out = batch.column(1).to_pylist(), []
            for text, file, at in zip(batch.column(0).to_pylist(), files, batch.column(2).to_pylist(), strict=True):
                text = text.replace("\r", "")
                if at == 0 and file not in begun:
                    begun.add(file)
                    text = text[1:] if text.startswith(">") else ""
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column(1)], names=["_rec", "file"])

    rows = raw.mapInArrow(records, "_rec string, file string")
    header = F.trim(F.substring_index("_rec", "\n", 1))
    body = F.when(F.contains("_rec", F.lit("\n")), F.expr("substring(_rec, instr(_rec, '\n') + 1)")).otherwise("")
    seq = F.regexp_replace(body, r"\s+", "")
    ident = F.split(header, r"\s+")[0] if first_token else header
    out = rows.select(ident.alias("sequence_id"), (F.upper(seq) if upper else seq).alias("sequence"), "file")
    return out.where("sequence_id <> ''")


def read_manifest(spark: SparkSession, path: str, split: str = "train", most: int | None = None, seed: int = 42) -> DataFrame:
    """Rows of a manifest CSV of one split, without viruses, with a tokenised path and a family; a seeded sample of ``most``."""
    df = spark.read.option("header", True).csv(path).where((F.col("domain") != "Viruses") & (F.col("split") == split))
    df = df.where((F.coalesce("tokenized_path", F.lit("")) != "") & (F.coalesce("family", F.lit("")) != ""))
    levels = [F.col(f"`{c}`") for c in ("domain", "phylum", "class", "order", "family", "genus", "species")]
    df = df.withColumn("lineage", S.lineage(levels))
    return df if most is None else df.orderBy(F.xxhash64("tokenized_path", F.lit(seed)), "tokenized_path").limit(most)


def read_npy(spark: SparkSession, path: str, dtype: str = "array<double>") -> DataFrame:
    """``file, row, values`` of ``.npy`` arrays: a row per first axis of matrices, one row of flat arrays."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int32() if "int" in dtype else pa.float64())
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                a = a.reshape(1, -1) if a.ndim < 2 else a.reshape(len(a), -1)
                for lo in range(0, len(a), 4096):
                    part = a[lo : lo + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(part)), pa.array(range(lo, lo + len(part)), pa.int64()), pa.array(part.tolist(), kind)], names=["file", "row", "values"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"file string, row long, values {dtype}")


def read_tokens(spark: SparkSession, path: str, max_tokens: int) -> DataFrame:
    """Token arrays, flat and of one length."""
    return read_npy(spark, path, "array<int>").withColumn("values", S.padded(F.col("values"), max_tokens))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``ordinal, line``: trimmed lines that are not empty, in order of the file."""
    df = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")
    return df.withColumn("ordinal", F.monotonically_increasing_id())


def with_taxa(embeddings: DataFrame, taxa: DataFrame) -> DataFrame:
    """Join ``embeddings(row, values)`` and ``taxa(ordinal, line)`` by place; ValueError if the numbers differ."""
    from pyspark.sql import Window

    n, m = embeddings.count(), taxa.count()
    if n != m:
        raise ValueError(f"{n} embeddings, but {m} taxa")
    # The file's lines get consecutive numbers from their partitions' sizes; only those sizes come to the driver.
    part = taxa.withColumn("_p", F.spark_partition_id())
    sizes = sorted((r["_p"], r["count"]) for r in part.groupBy("_p").count().collect())
    before, total = {}, 0
    for p, c in sizes:
        before[p] = total
        total += c
    base = F.lit(0)
    for p, b in before.items():
        base = F.when(F.col("_p") == p, b).otherwise(base)
    numbered = part.withColumn("row", base + F.row_number().over(Window.partitionBy("_p").orderBy("ordinal")) - 1)
    return embeddings.join(numbered.select("row", F.col("line").alias("taxon_id")), "row").select("row", "taxon_id", F.col("values").alias("embedding"))


def read_tree(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a tree JSON with their own ids; nodes without an embedding go, and so do the edges at them."""
    raw = spark.read.option("multiLine", True).schema(
        "nodes array<struct<node_id int, taxon_id string, parent int, embedding array<double>>>, edges array<struct<source int, target int, length double, support double>>"
    ).json(path)
    nodes = raw.select(F.explode("nodes").alias("n")).select("n.*").where("size(embedding) > 0")
    nodes = nodes.withColumn("taxon_id", F.coalesce("taxon_id", F.concat(F.lit("node_"), F.col("node_id"))))
    ids = nodes.select("node_id")
    edges = raw.select(F.explode("edges").alias("e")).select("e.*")
    edges = edges.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi").join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi")
    return nodes, edges


def read_prototypes_json(spark: SparkSession, path: str, kappa: float = KAPPA) -> DataFrame:
    """Prototypes of a JSON-lines file, pulled back into the ball."""
    schema = "taxon_id string, rank int, embedding array<double>, lineage array<string>, observation_count long"
    return spark.read.schema(schema).json(path).withColumn("embedding", G.clamp_to_ball(F.col("embedding"), kappa))


#: The anchor whose direction is the zero of angles.
ANCHOR = "E_coli_K12_MG1655"


@dataclass(frozen=True)
class Datum:
    """A coordinate datum: the plane of angles, the grand mean in the tangent space, the anchor's raw angle and the centroids' (r, theta)."""

    kappa: float
    plane: list[list[float]]
    grand: list[float]
    anchor: float
    centroids: dict[str, tuple[float, float]]

    def coordinates(self, points: DataFrame) -> DataFrame:
        """``id, r, theta, sigma_r, sigma_theta`` of ``points(id, embedding)``; rows of another dimension or outside the ball go."""
        z = F.col("embedding")
        kept = points.where(G.valid_v1(z, len(self.grand)))
        found = kept.select("id", G.radial_v1(z).alias("r"), G.angular_v1(z, self.plane, self.grand, self.anchor).alias("theta"))
        u = found.withColumn("u", G.uncertainty_v1(F.col("r"), F.col("theta"), list(self.centroids.values())))
        return u.select("id", "r", "theta", F.col("u.sigma_r").alias("sigma_r"), F.col("u.sigma_theta").alias("sigma_theta"))


def read_datum(spark: SparkSession, path: str) -> Datum:
    """The coordinate datum of a JSON file; ValueError unless kappa is 1.25, the plane has two rows and the anchor is there."""
    data = json.loads(spark.read.text(path, wholetext=True).first()[0])
    kappa = float(data.get("kappa", KAPPA))
    if kappa != KAPPA:
        raise ValueError("the datum is not of curvature 1.25")
    plane, grand = data["projection_matrix_P"], data["tangent_space_grand_centroid"]
    if len(plane) != 2 or any(len(row) != len(grand) for row in plane):
        raise ValueError("the datum's plane must have two rows of the grand mean's length")
    anchor = data["reference_anchors"].get(ANCHOR)
    if anchor is None:
        raise ValueError("the datum has no anchor")
    centroids = {name: (float(x["r"]), float(x["theta"])) for name, x in data.get("domain_centroids", {}).items()}
    return Datum(kappa, plane, grand, float(anchor.get("theta_raw", 0.0)), centroids)
