"""A corpus pipeline: quality rules, near-dedup, decontamination, mixing, token output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hueweave.llm import decontam, mixing, quality, simhash, token_output
from hueweave.runtime import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the divergence rules. Null and empty texts fail; repeated rows are judged alike; no rows give none."""
    return quality.quality_rules(docs).where("kept").select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8): the first by doc_id, null last.

    Null and empty texts are one group; rows without doc_id are grouped like any other; rows of one doc_id with
    different texts are documents of their own; no rows give none.
    """
    return simhash.drop_near_duplicates(docs).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, each judged by its own text whatever its doc_id. Null and empty texts stay; no items leave all."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row a copy. Texts without a word count no words; null is a source of its own; no rows give none."""
    return mixing.emit_copies(mixing.mix_sources(docs), COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's place and digest in the written token blocks, by doc_id (null first), repeats included. Null and empty texts have the end id alone."""
    return token_output.token_output(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID output", token_stage),
]

#: Fingerprints, tokens and the grammar have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*[F.col(c) for c in COLUMNS])
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{i}")
    return docs
