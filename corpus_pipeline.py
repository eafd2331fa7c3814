"""The corpus pipeline: documents through the stages of ``STAGES``, each written as Parquet and reread.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns
the columns of documents; the last returns the packed pieces.

Defined cases: null and empty texts aren't toxic, stay in near_duplicates (each of them), hold no secret
and are left out by the mix, which takes no words of them; repeated rows are copies, of which
near_duplicates keeps one; rows without doc_id or source pass as others do (a null source is a source of its own); an
empty table gives an empty result; columns beyond those of documents, also with names that stages use
inside, are carried on to the mixing stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from retrievo.llm import jaccard, mixing, packing, secret_scan, toxicity
from retrievo.llm.storage import materialize, table
from retrievo.sources.scratch import spread


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.accept(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five words, similarity 0.8."""
    return jaccard.keep_one(docs, n=5, percent=80)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in any layer of encoding are masked."""
    return secret_scan.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or cut to their targets and put in the order of training."""
    return mixing.apply_mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1,024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Learned models, component search and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
