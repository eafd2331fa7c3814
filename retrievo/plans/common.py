"""What the registered queries share: roles of the driver's tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retrievo.operators import judgements, lexical
from retrievo.sources.scratch import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is relevant to the benchmark items whose whole text it holds."""
    return written(judgements.containment(corpus(spark, sf_dir), items(spark, sf_dir)), "qrels").withColumn("score", F.lit(1))


def run(spark: SparkSession, sf_dir: str, k: int = 100) -> DataFrame:
    return lexical.bm25(corpus(spark, sf_dir), items(spark, sf_dir), k)


TOKENS = r"""
toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents),
qtoks AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM benchmark),
posts AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
nd AS (SELECT count(*) AS n_docs FROM documents),
kept AS (SELECT term, df, n_docs, ln((1 + n_docs) / (1 + df)) AS idf FROM dfs, nd WHERE df <= 0.65 * n_docs),
lens AS (SELECT d.doc_id, CAST(coalesce(sum(p.tf), 0) AS BIGINT) AS length FROM documents d LEFT JOIN (SELECT p.* FROM posts p SEMI JOIN kept USING (term)) p USING (doc_id) GROUP BY d.doc_id),
av AS (SELECT avg(length) AS average FROM lens),
contrib AS (
  SELECT q.query_id, p.doc_id, p.term, p.tf, k.idf, k.idf * p.tf * 2.5::DOUBLE / (p.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.length / a.average)) AS score
  FROM qtoks q JOIN kept k USING (term) JOIN posts p USING (term) JOIN lens l USING (doc_id), av a),
scored AS (SELECT query_id, doc_id, round(sum(score), 9) AS score FROM contrib GROUP BY ALL HAVING round(sum(score), 9) > 0),
run AS (SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 100)"""

QRELS = "qrels AS (SELECT item_id AS query_id, doc_id, 1 AS score FROM benchmark b, documents d WHERE contains(d.text, b.text))"


def with_run(select: str, more: str = "") -> str:
    """SQL over toks, posts, kept, lens, contrib, run and qrels."""
    return f"WITH {TOKENS},\n{QRELS}{',' + more if more else ''}\n{select}"
