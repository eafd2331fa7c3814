"""Evaluation of rankings (query_id, doc_id, rank) against judgements (query_id, doc_id, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def positive(qrels: DataFrame) -> DataFrame:
    return qrels.filter("score > 0").select("query_id", "doc_id").distinct()


def per_query(run: DataFrame, qrels: DataFrame, ks: tuple[int, ...] = (10,), precision: str = "returned", skip_empty: bool = False, queries: DataFrame | None = None, totals: DataFrame | None = None) -> DataFrame:
    """query_id, k, rr, recall, precision for every judged query; a query without a run scores 0.

    ``precision``: divide by the number returned in the top k, or by k ("constant").  Queries whose
    judgements are all zero count as 0 unless ``skip_empty``.  With ``totals(query_id, relevant)``, ``qrels``
    need only hold the judgements of documents in the run.
    """
    relevant = positive(qrels)
    judged = (queries if queries is not None else qrels if totals is None else totals).select("query_id").distinct()
    hits = run.join(relevant.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    top = hits.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter("rank <= k")
    found = top.groupBy("query_id", "k").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("returned"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"))
    total = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant")) if totals is None else totals
    base = judged.join(total, "query_id", "inner" if skip_empty else "left").withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    out = base.join(found, ["query_id", "k"], "left")
    by = F.col("returned") if precision == "returned" else F.col("k")
    zero = F.lit(0.0)
    return out.select(
        "query_id", "k", F.coalesce(1 / F.col("first"), zero).alias("rr"), F.coalesce(F.col("hits") / F.col("relevant"), zero).alias("recall"), F.coalesce(F.col("hits") / by, zero).alias("precision"),
    )


def summary(per_query_rows: DataFrame, *by: str) -> DataFrame:
    return per_query_rows.groupBy(*by, "k").agg(
        F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("precision"), 6).alias("precision"),
        F.round(F.avg((F.col("rr") > 0).cast("double")), 6).alias("hit_rate"), F.count(F.lit(1)).alias("n"),
    )


def trec(run: DataFrame, qrels: DataFrame, k: int = 10, depth: int = 100) -> DataFrame:
    """query_id, ndcg, recall, ap, rr: graded NDCG and recall at k, average precision and reciprocal rank to ``depth``."""
    graded = run.filter(F.col("rank") <= depth).select("query_id", "doc_id", "rank").join(qrels.filter("score > 0"), ["query_id", "doc_id"])
    seen = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    graded = graded.select("query_id", "rank", F.col("score").alias("grade"), seen.alias("hits"))
    got = graded.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, F.col("grade") / F.log2(F.col("rank") + 1.0))).alias("dcg"), F.sum(F.col("hits") / F.col("rank")).alias("ap"),
        F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias("found"),
    )
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    ideal = qrels.filter("score > 0").withColumn("at", at).groupBy("query_id").agg(
        F.sum(F.when(F.col("at") <= k, F.col("score") / F.log2(F.col("at") + 1.0))).alias("best"), F.count(F.lit(1)).alias("relevant"),
    )
    zero = F.lit(0.0)
    out = ideal.join(got, "query_id", "left")
    return out.select(
        "query_id", F.coalesce(F.col("dcg") / F.col("best"), zero).alias("ndcg"), F.coalesce(F.col("found") / F.col("relevant"), zero).alias("recall"),
        F.coalesce(F.col("ap") / F.col("relevant"), zero).alias("ap"), F.coalesce(1 / F.col("first"), zero).alias("rr"),
    )


def f_beta(predicted: DataFrame, relevant: DataFrame, beta: float = 2.0) -> DataFrame:
    """Micro precision, recall and F over the union of predicted and relevant pairs."""
    p = predicted.select("query_id", "doc_id", F.lit(1).alias("p")).distinct()
    r = relevant.select("query_id", "doc_id", F.lit(1).alias("r")).distinct()
    counts = p.join(r, ["query_id", "doc_id"], "full").agg(
        F.count_if(F.col("p").isNotNull() & F.col("r").isNotNull()).alias("tp"), F.count_if(F.col("r").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, b2 = F.col("tp"), beta * beta
    precision, recall = ratio(tp, tp + F.col("fp")), ratio(tp, tp + F.col("fn"))
    return counts.select("tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), ratio((1 + b2) * precision * recall, b2 * precision + recall).alias("f"))


def classes(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """tp, fp and fn of each query; ``beyond`` counts relevant documents ranked below k."""
    both = run.select("query_id", "doc_id", "rank").join(positive(qrels).withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "full")
    inside = F.coalesce(F.col("rank") <= k, F.lit(False))
    return both.groupBy("query_id").agg(
        F.count_if(inside & F.col("hit").isNotNull()).alias("tp"), F.count_if(inside & F.col("hit").isNull()).alias("fp"),
        F.count_if(~inside & F.col("hit").isNotNull()).alias("fn"), F.count_if(~inside & F.col("hit").isNotNull() & F.col("rank").isNotNull()).alias("beyond"),
    )


def worst(counts: DataFrame, n: int = 20) -> DataFrame:
    """The n queries of ``classes`` with most misses, worst first."""
    return counts.orderBy(F.desc("fn"), "query_id").limit(n)


def browsed(queries: DataFrame, run: DataFrame, qrels: DataFrame, needle: str, n: int = 50, preview: int = 80) -> DataFrame:
    """Queries whose id or preview holds ``needle`` (case ignored), by the best rank of a relevant document; those without one last."""
    best = run.join(positive(qrels), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("best"), F.max("rank").alias("worst"))
    shown = queries.select("query_id", F.substring("text", 1, preview).alias("preview"))
    wanted = F.lower("preview").contains(needle.lower()) | F.col("query_id").cast("string").contains(needle)
    return shown.filter(wanted).join(best, "query_id", "left").orderBy(F.asc_nulls_last("best"), "query_id").limit(n)
