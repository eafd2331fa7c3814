"""Deterministic samples and splits: the order is that of a hash of the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: str, salt: str = ""):
    return F.md5(F.concat(F.lit(salt), F.col(key).cast("string")))


def stratified(rows: DataFrame, key: str, stratum: str, n: int) -> DataFrame:
    """n rows, shared by stratum size: at least 1 each while any are left, the last stratum takes the rest."""
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("size"))
    whole = Window.orderBy(stratum)
    sizes = sizes.withColumn("total", F.sum("size").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    wish = F.greatest(F.lit(1), F.round(F.lit(n) * F.col("size") / F.col("total"))).cast("long")
    sizes = sizes.withColumn("wish", F.least(wish, F.col("size"))).withColumn("last", F.lead(stratum).over(whole).isNull())
    before = F.coalesce(F.sum("wish").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.greatest(F.lit(n) - before, F.lit(0))
    sizes = sizes.withColumn("quota", F.least(F.col("size"), F.when(F.col("last"), left).otherwise(F.least("wish", left))))  # a row per stratum
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(hash_order(key), key))
    return rows.withColumn("place", place).join(sizes.select(stratum, "quota"), stratum).filter("place <= quota").drop("place", "quota")


def balanced(rows: DataFrame, key: str, variant: str, n: int) -> DataFrame:
    """n rows of each variant."""
    place = F.row_number().over(Window.partitionBy(variant).orderBy(hash_order(key), key))
    return rows.withColumn("place", place).filter(F.col("place") <= n).drop("place")


def rank_range_negatives(run: DataFrame, qrels: DataFrame, ranges: tuple[tuple[int, int, int], ...] = ((2, 15, 4), (51, 100, 1))) -> DataFrame:
    """Of each rank range (first, last, count) the first ``count`` ranked documents that aren't relevant."""
    negatives = run.join(qrels, ["query_id", "doc_id"], "left_anti")
    out = None
    for i, (low, high, count) in enumerate(ranges):
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
        part = negatives.filter(F.col("rank").between(low, high)).withColumn("place", place).filter(F.col("place") <= count).select("query_id", "doc_id", "rank", F.lit(i).alias("band"))
        out = part if out is None else out.unionByName(part)
    return out


def hard_negatives(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    return run.filter(F.col("rank") <= k).join(qrels, ["query_id", "doc_id"], "left_anti")


def filled_negatives(hard: DataFrame, docs: DataFrame, qrels: DataFrame, n: int) -> DataFrame:
    """Hard negatives topped up to n a query with documents in hash order; the candidates are as many as the query with most judged documents may need."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    have = hard.withColumn("place", place).filter(F.col("place") <= n).select("query_id", "doc_id", "place")
    need = qrels.select("query_id").distinct().join(have.groupBy("query_id").agg(F.max("place").alias("have")), "query_id", "left").withColumn("have", F.coalesce("have", F.lit(0))).filter(F.col("have") < n)
    judged = qrels.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    spare = docs.select("doc_id").orderBy(hash_order("doc_id", "fill"), "doc_id").limit(2 * n + judged)
    extra = need.join(F.broadcast(spare)).join(qrels, ["query_id", "doc_id"], "left_anti").join(have, ["query_id", "doc_id"], "left_anti")
    extra = extra.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(hash_order("doc_id", "fill"), "doc_id")) + F.col("have"))
    return have.unionByName(extra.filter(F.col("at") <= n).select("query_id", "doc_id", F.col("at").alias("place")))


def repeated(rows: DataFrame, times: int) -> DataFrame:
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))


def rotating(rows: DataFrame, per_query: int, epochs: int) -> DataFrame:
    """For each epoch the next ``per_query`` rows of each query, starting over at the end (rows have place from 0)."""
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    slots = rows.withColumn("n", n).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    return slots.filter(F.pmod(F.col("place") - F.col("epoch") * per_query, F.col("n")) < per_query).drop("n")


def case_split(queries: DataFrame, cases: DataFrame) -> DataFrame:
    """The split of each query's case, for any number of query sets over the same cases."""
    return queries.join(cases.select("case_id", "split"), "case_id")


def oversampled(rows: DataFrame, positive: str = "label", factor: int = 10) -> DataFrame:
    """Positives repeated up to min(factor * positives, negatives)."""
    counts = rows.agg(F.count_if(F.col(positive) == 1).alias("p"), F.count_if(F.col(positive) != 1).alias("n"))
    want = F.greatest(F.lit(1), F.floor(F.least(F.col("p") * factor, F.col("n")) / F.greatest("p", F.lit(1)))).cast("int")
    out = rows.join(F.broadcast(counts))  # one row
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col(positive) == 1, want).otherwise(1)))).drop("p", "n")


def spread_clusters(distances, sizes: list[int], wanted: int) -> list[int]:
    """Greedy choice of test clusters: each time the one farthest from the rest that stays, the least number first.

    ``distances`` is the matrix of the clusters' centroids, some dozens, so this runs on the driver.
    """
    stay, chosen, total = set(range(len(sizes))), [], 0
    while total < wanted and len(stay) > 1:
        best = max(sorted(stay), key=lambda c: min(distances[c][o] for o in stay if o != c))
        stay.remove(best)
        chosen.append(best)
        total += sizes[best]
    return chosen
