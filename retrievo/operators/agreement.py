"""Annotators' labels: progress, agreement, majority, latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retrievo.operators.stats import kappa


def latest(labels: DataFrame, time: str = "created_at", *keys: str) -> DataFrame:
    """The last record of each key; ties by the record's own columns, so reruns agree."""
    keys = keys or ("annotator", "pair_id")
    rest = sorted(c for c in labels.columns if c not in (*keys, time))
    order = Window.partitionBy(*keys).orderBy(F.desc(time), *[F.desc(c) for c in rest])
    return labels.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def pairwise(labels: DataFrame) -> DataFrame:
    """Kappa and agreement of every two annotators on the pairs both labelled; under two pairs null."""
    a = labels.select("pair_id", F.col("annotator").alias("a1"), F.col("label").alias("x"))
    b = labels.select("pair_id", F.col("annotator").alias("a2"), F.col("label").alias("y"))
    out = kappa(a.join(b, "pair_id").filter("a1 < a2"), "x", "y", "a1", "a2")
    return out.withColumn("kappa", F.when(F.col("n") >= 2, F.col("kappa")))


def majority(labels: DataFrame, annotators: int | None = None) -> DataFrame:
    """pair_id, votes, n, label: more than half; ties are 0.  ``annotators``: only pairs that so many labelled."""
    out = labels.groupBy("pair_id").agg(F.sum("label").alias("votes"), F.count(F.lit(1)).alias("n"))
    out = out if annotators is None else out.filter(F.col("n") == annotators)
    return out.withColumn("label", (F.col("votes") * 2 > F.col("n")).cast("int"))


def confusion(rows: DataFrame, predicted: str, actual: str, *by: str) -> DataFrame:
    p, a = F.col(predicted) == 1, F.col(actual) == 1
    return rows.groupBy(*by).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))


def progress(annotators: DataFrame, labels: DataFrame, total: int) -> DataFrame:
    done = labels.groupBy("annotator").agg(F.count_distinct("pair_id").alias("done"))
    out = annotators.join(done, "annotator", "left").withColumn("done", F.coalesce("done", F.lit(0)))
    return out.select("annotator", "done", (F.lit(total) - F.col("done")).alias("remaining"), F.round(100 * F.col("done") / F.lit(max(total, 1)), 1).alias("percent"))


def next_pair(pairs: DataFrame, labels: DataFrame, annotator: str) -> DataFrame:
    """The first pair in the annotator's own shuffled order that has no label of theirs."""
    mine = labels.filter(F.col("annotator") == annotator)
    return pairs.join(mine, "pair_id", "left_anti").orderBy(F.sha2(F.concat_ws(":", F.lit(annotator), F.col("pair_id").cast("string")), 256), "pair_id").limit(1)


def shuffled(pairs: DataFrame, annotator: str) -> DataFrame:
    return pairs.orderBy(F.sha2(F.concat_ws(":", F.lit(annotator), F.col("pair_id").cast("string")), 256), "pair_id")


def export(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """All labels with what is known of their pairs, empty strings for the rest."""
    out = labels.join(pairs, "pair_id", "left")
    return out.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in out.columns])
