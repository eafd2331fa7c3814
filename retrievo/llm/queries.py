"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrievo.llm import jaccard, lm, media, mixing, negatives, neighbours, packing, pii, secret_scan, sharding, stamps, superminhash, toxicity
from retrievo.llm.storage import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "position")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.sanitise(table(spark, sf_dir, "documents")))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = media.media_columns(table(spark, sf_dir, "documents"))
    return columns.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op11_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stamps.normalise(table(spark, sf_dir, "stamps")).select("stamp_id", "utc_us", "rule", "ambiguous")


def op12_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"), n=2)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    mined = negatives.mine(vectors.withColumn("label", wrong))
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def queries() -> dict[str, Query]:
    return {
        "op1_mixing": op1_mixing,
        "op2_toxicity": op2_toxicity,
        "op3_sharding": op3_sharding,
        "op4_pii": op4_pii,
        "op5_lm": op5_lm,
        "op6_media": op6_media,
        "op7_jaccard": op7_jaccard,
        "op8_neighbours": op8_neighbours,
        "op9_packing": op9_packing,
        "op10_secrets": op10_secrets,
        "op11_stamps": op11_stamps,
        "op12_near_duplicates": op12_near_duplicates,
        "op13_negatives": op13_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.SQL, "op4_pii": pii.SQL, "op7_jaccard": jaccard.SQL, "op11_stamps": stamps.SQL, "op12_near_duplicates": superminhash.SQL, "op13_negatives": negatives.SQL}
