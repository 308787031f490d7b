"""From files to results: readers, encoder, operators and report columns put together.

Every function takes a path that Spark can read and gives a DataFrame, ready for ``writers.write_tsv`` or ``write_jsonl``; nothing
runs on the driver but the model's bounded tables.  An encoder is any object with ``encode_batch``; without one k-mers are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horocycle.functions import geometry as G
from horocycle.functions import sequences as S
from horocycle.functions.constants import KAPPA, TOP_K
from horocycle.operators import calibration as C
from horocycle.operators import chimera, novelty, placement, reference
from horocycle.sources import readers, writers

FAMILY = 4


def encoded_fasta(spark: SparkSession, path: str, encoder=None, least: int = 0) -> DataFrame:
    """``qid, sequence, embedding`` of the records of at least ``least`` letters; the first word of a header is its id."""
    found = readers.read_fasta(spark, path, first_token=True).where(F.length("sequence") >= least)
    return S.encoded(found.select(F.col("sequence_id").alias("qid"), "sequence"), encoder)


def place_embeddings(queries: DataFrame, prototypes: DataFrame, scores: DataFrame | None = None, k: int = TOP_K, mode: str = "flat", kappa: float = KAPPA) -> DataFrame:
    """Calibrated placements of ``queries(qid, embedding)``; ``mode`` is flat or hierarchical, ``scores(rank, score)`` are for calibration."""
    if mode not in ("flat", "hierarchical"):
        raise ValueError(f"unknown mode {mode!r}")
    place = placement.place_flat if mode == "flat" else placement.place_hierarchical
    scores = C.no_scores(queries.sparkSession) if scores is None else scores
    return placement.calibrated(place(queries, prototypes, k, kappa), scores)


def place_fasta(spark: SparkSession, path: str, prototypes: DataFrame, scores: DataFrame | None = None, encoder=None, k: int = TOP_K, mode: str = "flat", least: int = 0) -> DataFrame:
    """Placements of the sequences of a FASTA file, with the columns of a placement report beside ``candidates``."""
    return place_embeddings(encoded_fasta(spark, path, encoder, least).select("qid", "embedding"), prototypes, scores, k, mode)


def place_fasta_to(spark: SparkSession, path: str, prototypes: DataFrame, out: str, form: str = "tsv", **options) -> None:
    """Write the placements of a FASTA file as tsv, jsonl or jplace."""
    if form not in ("tsv", "jsonl", "jplace"):
        raise ValueError(f"unknown format {form!r}")
    found = place_fasta(spark, path, prototypes, **options)
    if form == "jplace":
        writers.write_jplace(found, out)
    else:
        (writers.write_tsv if form == "tsv" else writers.write_jsonl)(writers.placement_rows(found), out)


def detect_chimeras(spark: SparkSession, path: str, encoder=None, size: int = S.WINDOW, stride: int = S.STRIDE, least: int = S.MIN_WINDOW, **options) -> DataFrame:
    """The columns of a chimera report for each sequence of a FASTA file that gives a window."""
    found = readers.read_fasta(spark, path, first_token=True).select("sequence_id", "sequence")
    cut = found.select("sequence_id", F.posexplode(S.windows(F.col("sequence"), size, stride, least)).alias("window_idx", "sequence"))
    scored = chimera.chimera_scores(S.encoded(cut, encoder), **options)
    return writers.chimera_rows(scored.join(found.select("sequence_id", F.length("sequence").cast("long").alias("length")), "sequence_id"))


def triage_fasta(spark: SparkSession, path: str, prototypes: DataFrame, rank: int = FAMILY, encoder=None, k: int = novelty.SIGMA_K) -> DataFrame:
    """The columns of a triage report: each sequence against the prototypes of one rank and their field."""
    own = prototypes.where(F.col("rank") == rank).select("id", "embedding")
    return writers.triage_rows(novelty.triage(encoded_fasta(spark, path, encoder), own, novelty.sigma_field(own, k), k))


def novelty_fasta(spark: SparkSession, path: str, prototypes: DataFrame, rank: int = FAMILY, encoder=None, k: int = 5) -> DataFrame:
    """The columns of a novelty report: each sequence against the leave-one-out threshold of one rank's prototypes."""
    own = prototypes.where(F.col("rank") == rank).select("id", "embedding")
    return writers.novelty_rows(novelty.novelty(encoded_fasta(spark, path, encoder), own, novelty.novelty_threshold(own), k))


def build_reference(sequences: DataFrame, path: str, encoder=None, rank: int = FAMILY, kappa: float = KAPPA) -> DataFrame:
    """Prototypes of all ranks down to ``rank`` from ``sequences(sequence_id, sequence, lineage)``, saved at ``path`` and read again.

    Rows fold in the order of their ids; rows with a shorter lineage go.
    """
    kept = sequences.where(F.size("lineage") > rank)
    rows = S.encoded(kept.select("sequence_id", "sequence", F.slice("lineage", 1, rank + 1).alias("lineage")), encoder)
    leaves = rows.select(F.get("lineage", F.lit(rank)).alias("taxon_id"), "embedding", "lineage", F.col("sequence_id").alias("ordinal"))
    reference.save(reference.from_lineages(leaves, kappa), path, kappa)
    return reference.load(sequences.sparkSession, path)


def calibration_scores(placements: DataFrame, truth: DataFrame, rank: int = FAMILY) -> DataFrame:
    """``rank, score`` of ``placements`` whose lineage holds the true ``taxon`` of ``truth(qid, taxon)``: what thresholds are learnt from."""
    right = placement.scored(placements).join(truth, "qid").where(F.array_contains(F.split("lineage", ";"), F.col("taxon")) & F.col("score").isNotNull())
    return right.select(F.lit(rank).alias("rank"), "score")


def atlas_coordinates(spark: SparkSession, path: str, encoder=None, kappa: float = KAPPA) -> DataFrame:
    """``sequence_id, r, theta`` of the sequences of a FASTA file."""
    found = encoded_fasta(spark, path, encoder)
    return found.select(F.col("qid").alias("sequence_id"), G.dist_from_origin(F.col("embedding"), kappa).alias("r"), G.angle(F.col("embedding")).alias("theta"))


def save_calibration(scores: DataFrame, path: str, eps: tuple[float, float] = (0.10, 0.01)) -> None:
    """Write a calibrator's state: the ``rank, score`` rows and the two error rates."""
    scores.select("rank", "score").write.mode("overwrite").parquet(f"{path}/scores")
    scores.sparkSession.range(1).select(F.lit(eps[0]).alias("epsilon"), F.lit(eps[1]).alias("fallback_epsilon")).write.mode("overwrite").json(f"{path}/rates")


def load_calibration(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(scores, thresholds) of a state that ``save_calibration`` wrote."""
    scores = spark.read.parquet(f"{path}/scores")
    rates = spark.read.json(f"{path}/rates").first()
    return scores, C.thresholds(scores, eps=(rates["epsilon"], rates["fallback_epsilon"]))
