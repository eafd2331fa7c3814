"""Logs of retrieval agents: tool calls, token budgets, sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tool_stats(calls: DataFrame) -> DataFrame:
    """Per tool: calls, hit share, mean documents and mean seconds (tool, hit, n_docs, seconds)."""
    return calls.groupBy("tool").agg(
        F.count(F.lit(1)).alias("calls"), F.avg(F.col("hit").cast("double")).alias("hit_share"), F.avg("n_docs").alias("mean_docs"), F.avg("seconds").alias("mean_seconds"),
    )


def first_hit(calls: DataFrame) -> DataFrame:
    """How many queries hit first at each turn."""
    first = calls.filter("hit").groupBy("query_id").agg(F.min("turn").alias("turn"))
    return first.groupBy("turn").agg(F.count(F.lit(1)).alias("queries"))


def sequences(calls: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent sequences of tools, in the order of their turns."""
    path = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "tool"))), lambda s: s["tool"]), " > ")
    return calls.groupBy("query_id").agg(path.alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("queries")).orderBy(F.desc("queries"), "path").limit(n)


def budget(messages: DataFrame, tokens: Column, total: int = 32_768, soft: float = 0.8, hard: float = 0.92) -> DataFrame:
    """Running tokens of each conversation and the state of its budget."""
    running = F.sum("tokens").over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
    state = F.when(F.col("used") >= hard * total, "hard").when(F.col("used") >= soft * total, "soft").otherwise("ok")
    return messages.withColumn("tokens", tokens.cast("long")).withColumn("used", running).withColumn("state", state)


def log_summary(logs: DataFrame) -> DataFrame:
    return logs.agg(
        F.count(F.lit(1)).alias("queries"), F.avg("turns").alias("mean_turns"), F.max("turns").alias("max_turns"), F.avg("n_read").alias("mean_read"),
        F.avg("elapsed_s").alias("mean_seconds"), F.count("error").alias("errors"),
    )


def never_retrieved(qrels: DataFrame, *runs: DataFrame) -> DataFrame:
    """Relevant pairs that no run holds."""
    out = qrels
    for run in runs:
        out = out.join(run.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return out


def coverage(frames: DataFrame) -> DataFrame:
    """Whether a query declared two frames or more, each with documents (query_id, frame, n_docs)."""
    return frames.groupBy("query_id").agg(((F.count(F.lit(1)) >= 2) & F.every(F.col("n_docs") > 0)).alias("complete"))


def merged_scores(first: Column, second: Column) -> Column:
    """Two maps of scores with the greater of both."""
    return F.map_zip_with(first, second, lambda k, a, b: F.greatest(a, b))


def counter_delta(first: DataFrame, second: DataFrame, key: str, n: int = 25) -> DataFrame:
    """The n keys whose counts in two tables differ most: key, a, b, delta; the greater share of the first on top."""
    count = lambda rows, name: rows.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    both = count(first, "a").join(count(second, "b"), key, "full").fillna(0, ["a", "b"]).withColumn("delta", F.col("a") - F.col("b"))
    return both.orderBy(F.desc(F.abs("delta")), F.desc("delta"), key).limit(n)
