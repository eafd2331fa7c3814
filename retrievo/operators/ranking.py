"""Rankings as rows (query_id, doc_id, rank, score): top-k, fusion, re-ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_score(query_id: str = "query_id", doc_id: str = "doc_id", score: str = "score"):
    return Window.partitionBy(query_id).orderBy(F.desc(score), doc_id)


def top_k(scores: DataFrame, k: int, query_id: str = "query_id", doc_id: str = "doc_id", score: str = "score") -> DataFrame:
    """The k best of each query, ties by id; Spark keeps k rows a query before the shuffle."""
    rank = F.row_number().over(by_score(query_id, doc_id, score))
    return scores.select(query_id, doc_id, rank.alias("rank"), score).filter(F.col("rank") <= k)


def reciprocal_rank_fusion(first: DataFrame, second: DataFrame, k: int = 60) -> DataFrame:
    """Fuse two rankings of the same documents: 1/(k + rank) of both."""
    both = first.select("query_id", "doc_id", F.col("rank").alias("r1")).join(second.select("query_id", "doc_id", F.col("rank").alias("r2")), ["query_id", "doc_id"])
    return both.select("query_id", "doc_id", "r1", "r2", (1.0 / (k + F.col("r1")) + 1.0 / (k + F.col("r2"))).alias("score"))


def z_score(score: Column, over, ddof: int = 1) -> Column:
    spread = F.stddev_samp(score) if ddof else F.stddev_pop(score)
    return (score - F.avg(score).over(over)) / (spread.over(over) + 1e-8)


def blend(scores: DataFrame, alpha: float | Column, ddof: int = 1) -> DataFrame:
    """alpha * z(a) + (1 - alpha) * b over ``scores(query_id, doc_id, a, b)``."""
    z = z_score(F.col("a"), Window.partitionBy("query_id"), ddof)
    return scores.withColumn("score", alpha * z + (1 - alpha) * F.col("b"))


def debias(scores: DataFrame) -> DataFrame:
    """Subtract each document's mean over queries."""
    return scores.withColumn("score", F.col("score") - F.avg("score").over(Window.partitionBy("doc_id")))


def alpha_sweep(scores: DataFrame, qrels: DataFrame, k: int = 10, steps: int = 10) -> DataFrame:
    """Recall at k for alpha = 0, 1/steps, ..., 1; queries without judgements count as 0."""
    z = scores.withColumn("z", z_score(F.col("a"), Window.partitionBy("query_id")))
    grid = F.explode(F.array(*[F.lit(i / steps) for i in range(steps + 1)])).alias("alpha")
    tried = z.select("*", grid).withColumn("score", F.round(F.col("alpha") * F.col("z") + (1 - F.col("alpha")) * F.col("b"), 9))
    rank = F.row_number().over(Window.partitionBy("alpha", "query_id").orderBy(F.desc("score"), "doc_id"))
    best = tried.withColumn("rank", rank).filter(F.col("rank") <= k).select("alpha", "query_id", "doc_id")
    wanted = qrels.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    hits = best.join(qrels, ["query_id", "doc_id"], "left_semi").groupBy("alpha", "query_id").agg(F.count(F.lit(1)).alias("hits"))
    queries = tried.select("alpha", "query_id").distinct().join(wanted, "query_id", "left").join(hits, ["alpha", "query_id"], "left")
    recall = F.coalesce(F.col("hits") / F.col("relevant"), F.lit(0.0))
    return queries.groupBy("alpha").agg(F.avg(recall).alias("recall"))


def best_alpha(sweep: DataFrame) -> DataFrame:
    """The smallest alpha of the greatest recall."""
    return sweep.orderBy(F.desc("recall"), "alpha").limit(1)


def ensemble(scores: DataFrame, weights: dict[str, float], threshold: float | None = None) -> DataFrame:
    """Weighted mean over models of ``scores(model, query_id, doc_id, score)``; a missing score is 0."""
    total = sum(weights.values())
    weight = F.element_at(F.create_map(*[F.lit(x) for m, w in weights.items() for x in (m, w / total)]), F.col("model"))
    out = scores.groupBy("query_id", "doc_id").agg(F.sum(weight * F.col("score")).alias("score"))
    return out if threshold is None else out.filter(F.col("score") >= threshold)


def rerank(pool: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Order ``pool(query_id, doc_id, rank)`` by new scores; ties keep the pool's order."""
    joined = pool.select("query_id", "doc_id", F.col("rank").alias("pool_rank")).join(scores, ["query_id", "doc_id"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pool_rank"))
    return joined.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "doc_id", "rank", "score")


def score_once(pairs: DataFrame, cache: DataFrame, scorer) -> DataFrame:
    """Scores of distinct (query_id, doc_id): from the cache, and by ``scorer(DataFrame) -> DataFrame`` for the rest."""
    wanted = pairs.select("query_id", "doc_id").distinct()
    known = wanted.join(cache, ["query_id", "doc_id"])
    return known.unionByName(scorer(wanted.join(cache, ["query_id", "doc_id"], "left_anti")))


def padded(selected: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """Selected documents in their order, then others seen by score, k in all."""
    first = selected.select("query_id", "doc_id", F.lit(0).alias("source"), F.col("rank").cast("double").alias("key"))
    rest = seen.join(selected, ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", F.lit(1).alias("source"), (-F.col("score")).alias("key"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("source", "key", "doc_id"))
    return first.unionByName(rest).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "doc_id", "rank", "source")


def renumbered(rows: DataFrame, order: str, chunks: int = 64) -> DataFrame:
    """Ranks that start again whenever query_id changes in the order of the file (``order``: distinct numbers).

    Rows are numbered inside chunks of the order; what runs on from one chunk to the next is added
    from a table of a row for each chunk.
    """
    bounds = rows.approxQuantile(order, [i / chunks for i in range(1, chunks)], 0.001)
    chunk = F.lit(0)
    for bound in sorted(set(bounds)):
        chunk = chunk + (F.col(order) > bound).cast("int")
    inside = Window.partitionBy("chunk").orderBy(order)
    turn = (~F.lag("query_id").over(inside).eqNullSafe(F.col("query_id"))) & (F.row_number().over(inside) > 1)
    numbered = rows.withColumn("chunk", chunk).withColumn("turn", turn.cast("int")).withColumn("island", F.sum("turn").over(inside)).drop("turn")
    numbered = numbered.withColumn("rank", F.row_number().over(Window.partitionBy("chunk", "island").orderBy(order)))
    ends = numbered.groupBy("chunk").agg(F.min_by("query_id", order).alias("first"), F.max_by("query_id", order).alias("last"), F.max("island").alias("islands"), F.max_by("rank", order).alias("length"))
    carried, runs_on, last = {}, 0, None
    for r in ends.orderBy("chunk").collect():  # a row for each chunk
        carried[r["chunk"]] = runs_on if last is not None and last["last"] == r["first"] else 0
        runs_on, last = r["length"] + (carried[r["chunk"]] if r["islands"] == 0 else 0), r
    added = F.lit(0)
    for i, n in carried.items():
        added = F.when(F.col("chunk") == i, n).otherwise(added) if n else added
    return numbered.withColumn("rank", F.col("rank") + F.when(F.col("island") == 0, added).otherwise(0)).drop("chunk", "island")
