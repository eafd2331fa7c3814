"""Error analysis, popularity bias, vocabulary gaps and structure of judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap(a: Column, b: Column) -> dict[str, Column]:
    """Overlap figures of two token sets (distinct arrays); empty sets give 0."""
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    ratio = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    return {
        "n_shared": both.cast("long"), "jaccard": ratio(both, any_), "overlap": ratio(both, F.least(F.size(a), F.size(b))),
        "query_coverage": ratio(both, F.size(a)), "doc_coverage": ratio(both, F.size(b)),
    }


def gap_summary(pairs: DataFrame, jaccard: str = "jaccard") -> DataFrame:
    j = F.col(jaccard)
    share = lambda c: F.avg(c.cast("double"))
    return pairs.agg(
        F.count(F.lit(1)).alias("pairs"), share(j == 0).alias("zero_share"), F.avg(j).alias("mean"), F.percentile(j, 0.5).alias("median"),
        F.stddev_pop(j).alias("deviation"), share(j < 0.05).alias("under_05"), share(j < 0.1).alias("under_10"),
    )


def stratum(jaccard: Column) -> Column:
    return F.when(jaccard == 0, "zero").when(jaccard < 0.05, "low").when(jaccard <= 0.2, "moderate").otherwise("high")


def discriminative_terms(pairs: DataFrame, n: int = 30) -> DataFrame:
    """side, term, pairs: terms of the query only, the document only, and both, by number of pairs (q and d are sets)."""
    sides = F.explode(F.array(
        F.struct(F.lit("query").alias("side"), F.array_except("q", "d").alias("terms")), F.struct(F.lit("document").alias("side"), F.array_except("d", "q").alias("terms")),
        F.struct(F.lit("shared").alias("side"), F.array_intersect("q", "d").alias("terms")),
    )).alias("s")
    counts = pairs.select(sides).select("s.side", F.explode("s.terms").alias("term")).groupBy("side", "term").agg(F.count(F.lit(1)).alias("pairs"))
    rank = F.row_number().over(Window.partitionBy("side").orderBy(F.desc("pairs"), "term"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= n)


def document_frequency(qrels: DataFrame) -> DataFrame:
    return qrels.groupBy("doc_id").agg(F.count_distinct("query_id").alias("df"))


def hubs(frequency: DataFrame, q: float = 0.95) -> DataFrame:
    """Documents judged relevant at least as often as the q-th percentile."""
    threshold = frequency.agg(F.percentile("df", q).alias("threshold"))
    return frequency.join(F.broadcast(threshold)).withColumn("hub", F.col("df") >= F.col("threshold"))  # one row


def query_groups(qrels: DataFrame, hub_docs: DataFrame) -> DataFrame:
    """query_id, hub: whether any of its documents is a hub."""
    return qrels.join(hub_docs.select("doc_id", "hub"), "doc_id").groupBy("query_id").agg(F.max("hub").alias("hub"))


def added_pairs(before: DataFrame, after: DataFrame, hub_docs: DataFrame) -> DataFrame:
    """How many pairs expansion added to hubs and to others, and documents that had none before."""
    added = after.join(before, ["query_id", "doc_id"], "left_anti").join(hub_docs.select("doc_id", "hub"), "doc_id", "left")
    fresh = after.select("doc_id").distinct().join(before.select("doc_id").distinct(), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("new_docs"))
    hub = F.coalesce("hub", F.lit(False))
    counts = added.agg(F.count_if(hub).alias("hub_pairs"), F.count_if(~hub).alias("other_pairs"))
    return counts.withColumn("ratio", F.col("hub_pairs") / F.greatest("other_pairs", F.lit(1))).join(F.broadcast(fresh))  # one row each


def frequency_in_top(run: DataFrame, k: int = 10) -> DataFrame:
    """Share of queries that have a document among the first k."""
    n = run.agg(F.count_distinct("query_id").alias("n"))
    return run.filter(F.col("rank") <= k).groupBy("doc_id").agg(F.count_distinct("query_id").alias("queries")).join(F.broadcast(n)).select("doc_id", "queries", (F.col("queries") / F.col("n")).alias("share"))


def popularity_classes(frequency: DataFrame) -> DataFrame:
    bucket = F.when(F.col("df") == 1, "1").when(F.col("df") <= 5, "2-5").otherwise(">5")
    return frequency.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("docs"), F.sum("df").alias("pairs"))


def inverse_propensity(qrels: DataFrame) -> DataFrame:
    df = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    return qrels.withColumn("weight", 1 / F.log1p(df))


def structure(docs: DataFrame, act: str, order: str) -> DataFrame:
    """doc_id, act, act_id (from 0, by name) and position: place in the act from 0 to 1."""
    place, n = F.row_number().over(Window.partitionBy(act).orderBy(order)) - 1, F.count(F.lit(1)).over(Window.partitionBy(act))
    names = docs.select(act).distinct().select(act, (F.row_number().over(Window.orderBy(act)) - 1).alias("act_id"))  # a row per act
    return docs.select("doc_id", act, (place / F.greatest(n - 1, F.lit(1))).alias("position")).join(names, act)


def concentration(rows: DataFrame, width: float = 0.1) -> DataFrame:
    """query_id, n, span and the greatest share of positions within a window; 1 for a single one."""
    # the Python API takes whole numbers as bounds of a range only
    ahead = F.expr(f"count(1) OVER (PARTITION BY query_id ORDER BY position RANGE BETWEEN CURRENT ROW AND {float(width)!r}D FOLLOWING)")
    out = rows.withColumn("ahead", ahead).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("ahead").alias("most"), (F.max("position") - F.min("position")).alias("span"))
    return out.select("query_id", "n", "span", F.when(F.col("n") <= 1, F.lit(1.0)).otherwise(F.col("most") / F.col("n")).alias("concentration"))


def judged_pairs(qrels: DataFrame) -> DataFrame:
    """Unordered pairs of documents judged for the same query."""
    a, b = qrels.select("query_id", F.col("doc_id").alias("a")), qrels.select("query_id", F.col("doc_id").alias("b"))
    return a.join(b, "query_id").filter("a < b")


def band_join(rows: DataFrame, key: str, number: str, radius: int, *group: str) -> DataFrame:
    """Directed edges (src, dst) between rows of a group whose numbers differ by ``radius`` at most.

    Numbers fall in buckets of that width; a row meets its own bucket and the two beside it only.
    """
    cell = F.floor(F.col(number) / radius)
    a = rows.select(*group, F.col(key).alias("src"), F.col(number).alias("na"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    b = rows.select(*group, F.col(key).alias("dst"), F.col(number).alias("nb"), cell.alias("cell"))
    near = (F.abs(F.col("na") - F.col("nb")) <= radius) & (F.col("src") != F.col("dst"))
    return a.join(b, [*group, "cell"]).filter(near).select(*group, "src", "dst", (F.col("nb") - F.col("na")).alias("offset"))


def nearest(points: DataFrame, targets: DataFrame, key: str, number: str = "num") -> DataFrame:
    """For each point of a key the least distance to a target of the key, and that target.

    The nearest target is the last before or the first after.  Only distinct numbers of a key are sorted, once
    up and once down (a frame that ends with its row is kept up row by row); points then look theirs up.
    """
    both = points.select(key, F.col(number).alias("n"), F.lit(0).alias("t")).unionByName(targets.select(key, F.col(number).alias("n"), F.lit(1).alias("t")))
    both = both.groupBy(key, "n").agg(F.max("t").alias("target"), F.min("t").alias("point"))
    hit = F.when(F.col("target") == 1, F.col("n"))
    upward, downward = (Window.partitionBy(key).orderBy(c).rowsBetween(Window.unboundedPreceding, 0) for c in (F.col("n").asc(), F.col("n").desc()))
    out = both.withColumn("below", F.last(hit, ignorenulls=True).over(upward)).withColumn("above", F.last(hit, ignorenulls=True).over(downward)).filter("point = 0")
    down, up = F.col("n") - F.col("below"), F.col("above") - F.col("n")
    take = F.when(up.isNull() | (down <= up), F.col("below")).otherwise(F.col("above"))
    found = out.select(F.col(key).alias("_key"), F.col("n").alias("_n"), take.alias("nearest"), F.least(down, up).alias("distance"))
    rows = points.select(key, "id", F.col(number).alias(number)).join(found, F.col(key).eqNullSafe(F.col("_key")) & F.col(number).eqNullSafe(F.col("_n")))
    return rows.select(key, "id", number, "nearest", "distance")


def interval_lookup(rows: DataFrame, number: str, bounds: list[tuple[int, str]], last: str) -> DataFrame:
    """Name of the interval that holds a number: upper bounds (inclusive) in ascending order."""
    expr = F
    for high, name in bounds:
        expr = expr.when(F.col(number) <= high, name)
    return rows.withColumn("interval", expr.otherwise(last))


# The code's books by their last article.
BOOKS = [(498, "I (Orang)"), (1232, "II (Benda)"), (1864, "III (Perikatan)")]
LAST_BOOK = "IV (Pembuktian)"


def review_priority(rows: DataFrame) -> DataFrame:
    """Score, category and reasons of false positives (distance, same_book, gt_frequency, n_shared)."""
    near = F.when(F.col("distance") <= 20, 3).when(F.col("distance") <= 50, 2).otherwise(0)
    elsewhere, shared = F.coalesce("gt_frequency", F.lit(0)), F.col("n_shared")
    score = near + F.when(F.col("same_book"), 1).otherwise(0) + F.when(elsewhere > 0, 2).otherwise(0) + F.when(shared >= 3, 1).otherwise(0)
    reasons = F.concat_ws(
        "; ", F.when(F.col("distance") <= 20, "within 20").when(F.col("distance") <= 50, "within 50"), F.when(F.col("same_book"), "same book"),
        F.when(elsewhere > 0, F.concat(F.lit("judged for "), elsewhere)), F.when(shared >= 3, F.concat(shared, F.lit(" shared tokens"))),
    )
    category = F.when(F.col("priority") >= 4, "high").when(F.col("priority") >= 2, "medium").otherwise("low")
    return rows.withColumn("priority", score).withColumn("category", category).withColumn("reasons", reasons)


def helped(base: DataFrame, other: DataFrame, qrels: DataFrame) -> DataFrame:
    """query_id and whether the best relevant rank of ``other`` is better, worse or the same."""
    best = lambda run, name: run.join(qrels, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias(name))
    both = qrels.select("query_id").distinct().join(best(base, "base"), "query_id", "left").join(best(other, "other"), "query_id", "left")
    b, o = F.coalesce("base", F.lit(1 << 30)), F.coalesce("other", F.lit(1 << 30))
    return both.select("query_id", "base", "other", F.when(o < b, "helped").when(o > b, "hurt").otherwise("neutral").alias("effect"))
