"""A training-corpus pipeline of five operators, from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; ``run`` writes each result to shared storage and
reads it again as the next stage's ``docs``.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from horocycle.llm import decontam, jaccard, linededup, packing, quality, shared
from horocycle.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, and lines above a host's limits go from the others."""
    return quality.apply_rules(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of equal and nearly equal lines go; documents left without a word go."""
    return linededup.deduped(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents (0.8 of five-word shingles) the one with the smallest doc_id stays."""
    return jaccard.one_per_component(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item (0.8 of its five-word shingles) go."""
    return decontam.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), words=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, packed into sequences of 1024 tokens."""
    return packing.pack_documents(docs, tokenizer_path(), capacity=1024, end_id=2)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packed),
]

#: Tokenising and packing cannot be expressed in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; the tables of all stages before it are deleted when its pieces are written."""
    with shared.scratch(spark) as held:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for name, stage in STAGES[:-1]:
            with shared.scratch(spark) as own:
                docs = own.kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        name, stage = STAGES[-1]
        return held.kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
