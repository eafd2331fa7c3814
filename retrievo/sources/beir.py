"""Corpora, queries and judgements in files, and the predictions made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CORPUS = "_id STRING, title STRING, text STRING, metadata MAP<STRING, STRING>"
PREDICTIONS = (
    "qid STRING, method STRING, dataset STRING, ranked_doc_ids ARRAY<STRING>, ground_truth ARRAY<STRING>, doc_scores MAP<STRING, DOUBLE>, "
    "rankings ARRAY<STRUCT<rank: INT, doc_id: STRING, score: DOUBLE>>, error STRING, tool_call_log ARRAY<STRUCT<turn: INT, tool: STRING, doc_ids_returned: ARRAY<STRING>>>"
)


def _last(rows: DataFrame, *keys: str) -> DataFrame:
    """The last record of each key in file order."""
    rows = rows.withColumn("_at", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_at")))).filter("_n = 1").drop("_at", "_n")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, title, text, metadata; a missing title is empty, the last of repeated ids wins."""
    rows = spark.read.schema(CORPUS).json(path).filter("_id is not null")
    return _last(rows, "_id").select(F.col("_id").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), "text", "metadata")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    rows = _last(spark.read.schema("_id STRING, text STRING, metadata MAP<STRING, STRING>").json(path).filter("_id is not null"), "_id")
    return rows.select(F.col("_id").alias("query_id"), "text", F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, score of a tab-separated file with a header; short lines are skipped, the last of a pair wins."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="query_id STRING, doc_id STRING, score INT", mode="DROPMALFORMED", enforceSchema=True)
    return _last(rows.filter("query_id is not null and doc_id is not null and score is not null"), "query_id", "doc_id")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """qid, method, ranked, relevant of any of the three layouts of prediction files; layout names which."""
    rows = spark.read.schema(PREDICTIONS.replace("ground_truth ARRAY<STRING>", "ground_truth STRING")).json(path)
    nested = F.from_json("ground_truth", "array<struct<doc_id: string>>")
    plain = F.from_json("ground_truth", "array<string>")
    structs = F.col("ground_truth").rlike(r"^\[\s*\{")
    ranked = F.coalesce("ranked_doc_ids", F.transform("rankings", lambda r: r["doc_id"]))
    layout = F.when(F.col("tool_call_log").isNotNull(), "agent").when(F.col("rankings").isNotNull(), "ranking").otherwise("predictions")
    return rows.select("qid", "method", ranked.alias("ranked"), F.when(structs, F.transform(nested, lambda g: g["doc_id"])).otherwise(plain).alias("relevant"), layout.alias("layout"))


def prediction_records(run: DataFrame, qrels: DataFrame, per_query: DataFrame, method: str, dataset: str, depth: int = 100) -> DataFrame:
    """One record per query: ranking, judgements and metrics, scores to six places."""
    ranked = run.filter(F.col("rank") <= depth).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "score"))).alias("r"))
    truth = qrels.filter("score > 0").groupBy("query_id").agg(F.sort_array(F.collect_set("doc_id")).alias("ground_truth"))
    rows = truth.join(ranked, "query_id", "left").join(per_query.select("query_id", "recall", "rr"), "query_id", "left")
    scores = F.map_from_entries(F.transform("r", lambda x: F.struct(x["doc_id"].cast("string"), F.round(x["score"], 6))))
    return rows.select(
        F.col("query_id").alias("qid"), F.lit(method).alias("method"), F.lit(dataset).alias("dataset"), F.coalesce(F.transform("r", lambda x: x["doc_id"]), F.array()).alias("ranked_doc_ids"),
        "ground_truth", F.col("recall").alias("recall@10"), F.col("rr").alias("rr@10"), scores.alias("doc_scores"),
    )


def write_qrels(qrels: DataFrame, path: str) -> None:
    qrels.select("query_id", "doc_id", "score").orderBy("query_id", "doc_id").write.csv(path, sep="\t", header=True)


def write_dataset(path: str, corpus: DataFrame, queries: DataFrame, qrels: DataFrame) -> None:
    """The files of a dataset: corpus, queries, judgements by split, and its figures."""
    corpus.withColumnRenamed("doc_id", "_id").write.json(f"{path}/corpus.jsonl")
    queries.withColumnRenamed("query_id", "_id").write.json(f"{path}/queries.jsonl")
    for split in [r["split"] for r in qrels.select("split").distinct().collect()]:  # a few names
        write_qrels(qrels.filter(F.col("split") == split), f"{path}/qrels_{split}.tsv")
    figures = qrels.groupBy("split").agg(F.count(F.lit(1)).alias("judgements"), F.count_distinct("query_id").alias("queries"))
    figures.withColumn("per_query", F.col("judgements") / F.col("queries")).write.json(f"{path}/stats.json")


def write_pages(run: DataFrame, docs: DataFrame, path: str) -> None:
    """One folder of JSON per query: its ranking with texts, for a static viewer."""
    run.join(docs, "doc_id").write.partitionBy("query_id").json(path)


def trec_run(run: DataFrame, tag: str) -> DataFrame:
    """Lines "qid Q0 docid rank score tag" of ranked rows, in order."""
    rows = run.filter(F.col("rank").isNotNull()).orderBy("query_id", "rank")
    return rows.select(F.concat_ws(" ", F.col("query_id"), F.lit("Q0"), F.col("doc_id"), F.col("rank"), F.col("score"), F.lit(tag)).alias("value"))


def read_trec(spark: SparkSession, path: str) -> DataFrame:
    """A run (six fields) or judgements (four): query_id, doc_id, rank, score."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).filter(F.size("p").isin(4, 6))
    is_run = F.size("p") == 6
    return rows.select(F.col("p")[0].alias("query_id"), F.col("p")[2].alias("doc_id"), F.when(is_run, F.get("p", F.lit(3)).cast("int")).alias("rank"), F.when(is_run, F.get("p", F.lit(4))).otherwise(F.get("p", F.lit(3))).cast("double").alias("score"))


def embeddings(spark: SparkSession, paths: list[str], lookup: DataFrame) -> DataFrame:
    """Shards of (idx, embedding) with the ids of their rows."""
    return spark.read.parquet(*paths).join(lookup, "idx")


def cached(path: str, fingerprint: str, build, spark: SparkSession) -> DataFrame:
    """A table kept under a fingerprint of what it was built from; built if it isn't there."""
    from py4j.java_gateway import java_import

    java_import(spark._jvm, "org.apache.hadoop.fs.Path")
    target = f"{path}/{fingerprint}"
    place = spark._jvm.Path(target + "/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        build().write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
