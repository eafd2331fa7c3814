"""Learned re-rankers: features of pairs, boosted trees with oversampling, ranking, ensemble weights."""

from __future__ import annotations

from itertools import product as grid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrievo.functions.text import tokens
from retrievo.functions.vectors import product
from retrievo.operators import boosting
from retrievo.operators.ranking import top_k


def pair_features(pairs: DataFrame, queries: DataFrame, docs: DataFrame, *extra: str) -> DataFrame:
    """``features`` of (query_id, doc_id): component products of both vectors, then the named columns of ``pairs``."""
    joined = pairs.join(queries, "query_id").join(docs, "doc_id")
    parts = F.concat(product(F.col("q"), F.col("d")), *([F.array(*[F.col(c).cast("double") for c in extra])] if extra else []))
    return joined.withColumn("features", parts).drop("q", "d")


def text_features(pairs: DataFrame, queries: DataFrame, docs: DataFrame, title: int = 12, *extra: str) -> DataFrame:
    """``features`` of (query_id, doc_id) from texts: sparse product (1 + ln tf of shared tokens), cosine of the query's tokens with
    the document's title (its first ``title`` tokens), share of query tokens found, Jaccard similarity, then the named columns."""
    def worded(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.select(key, tokens(F.col("text")).alias(name))

    both = pairs.join(worded(queries, "query_id", "qs"), "query_id").join(worded(docs, "doc_id", "ds"), "doc_id")
    both = both.withColumns({"qset": F.array_distinct("qs"), "dset": F.array_distinct("ds"), "head": F.array_distinct(F.slice("ds", 1, title))})
    both = both.withColumns({"shared": F.array_intersect("qset", "dset"), "named": F.size(F.array_intersect("qset", "head"))})
    found = F.size("shared")
    # occurrences of shared tokens on either side
    repeats = lambda side: F.log1p(F.size(F.filter(side, lambda w: F.array_contains("shared", w))).cast("double"))
    part = lambda n, of: F.when(of > 0, n / of).otherwise(0.0)
    parts = [
        F.log1p(found.cast("double")) * repeats("qs"), part(F.col("named"), F.sqrt(F.size("qset") * F.size("head"))), part(found, F.size("qset")),
        part(found, F.size("qset") + F.size("dset") - found), *[F.col(c).cast("double") for c in extra],
    ]
    return both.withColumn("features", F.array(*parts)).drop("qs", "ds", "qset", "dset", "head", "shared", "named")


def positive_weight(rows: DataFrame, label: str, factor: int) -> Column:
    """The weight of a row when positives are to count ``factor`` times, or together as much as the negatives."""
    counts = rows.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n")).first()  # two numbers
    return F.when(F.col(label) == 1, max(1.0, min(float(factor), counts["n"] / max(counts["p"], 1)))).otherwise(1.0)


def fit_ranker(rows: DataFrame, label: str = "label", factor: int = 10, params: boosting.Boosting = boosting.Boosting()) -> boosting.Ensemble:
    """Boosted trees for relevance; positives weigh up to ``factor`` times, or as much as the negatives together."""
    return boosting.fit(rows.withColumn("times", positive_weight(rows, label, factor)), "features", label, "times", params)


def predict_top_k(model: boosting.Ensemble, rows: DataFrame, k: int) -> DataFrame:
    scored = rows.select("query_id", "doc_id", F.round(model.score(F.col("features")), 9).alias("score"))
    return top_k(scored, k)


def grid_of_weights(count, total: int, models: list[str], steps: int = 4, threshold: float = 0.5) -> list[tuple[int, dict[str, float], float]]:
    """(trial, weights, micro F2) of every weight vector on a grid; ``count(trials)`` gives (hits, predicted) of each (weights, threshold) in one pass."""
    vectors = [[float(w) for w in v] for v in grid(range(steps + 1), repeat=len(models)) if sum(v)]
    found = count([(v, threshold) for v in vectors])
    return [(i, {m: w / sum(v) for m, w in zip(models, v, strict=True)}, 5 * hits / (4 * total + predicted) if hits else 0.0) for i, (v, (hits, predicted)) in enumerate(zip(vectors, found, strict=True)) if predicted]


def search_weights(scores: DataFrame, relevant: DataFrame, models: list[str], steps: int = 4, threshold: float = 0.5) -> DataFrame:
    """Micro F2 of every weight vector on a grid, best first: one pass over the scores for all vectors."""
    vectors = [v for v in grid(range(steps + 1), repeat=len(models)) if sum(v)]
    table = scores.sparkSession.createDataFrame([(i, m, float(w) / sum(v)) for i, v in enumerate(vectors) for m, w in zip(models, v, strict=True)], "trial int, model string, weight double")
    summed = scores.join(F.broadcast(table), "model").groupBy("trial", "query_id", "doc_id").agg(F.round(F.sum(F.col("weight") * F.col("score")), 9).alias("score"))
    hits = summed.filter(F.col("score") >= threshold).join(relevant.select("query_id", "doc_id", F.lit(1).alias("r")), ["query_id", "doc_id"], "left")
    total = relevant.select("query_id", "doc_id").distinct().agg(F.count(F.lit(1)).alias("total"))
    counts = hits.groupBy("trial").agg(F.count("r").alias("tp"), F.count(F.lit(1)).alias("predicted")).join(F.broadcast(total))  # a row per trial
    f2 = F.when(F.col("tp") > 0, 5 * F.col("tp") / (4 * F.col("total") + F.col("predicted"))).otherwise(0.0)
    weights = table.groupBy("trial").agg(F.map_from_entries(F.collect_list(F.struct("model", "weight"))).alias("weights"))
    return counts.withColumn("f2", f2).join(F.broadcast(weights), "trial").select("trial", "weights", "f2").orderBy(F.desc("f2"), "trial")


def _trial_counts(wide: DataFrame, models: list[str], trials: list[tuple[list[float], float]]) -> list[tuple[int, int]]:
    """(hits, predicted) of each trial (weights, threshold) in one pass over ``wide(r, one column a model)``; nothing is shuffled but the sums."""
    sums = []
    for i, (weights, threshold) in enumerate(trials):
        total = sum(weights) or 1.0
        score = F.round(sum((F.col(m) * (w / total) for m, w in zip(models, weights, strict=True)), F.lit(0.0)), 9)
        sums += [F.count_if((score >= threshold) & F.col("r")).alias(f"hits{i}"), F.count_if(score >= threshold).alias(f"predicted{i}")]
    row = wide.agg(*sums).first()
    return [(row[f"hits{i}"], row[f"predicted{i}"]) for i in range(len(trials))]


def parzen_search(
    scores: DataFrame, relevant: DataFrame, models: list[str], *, trials: int = 40, together: int = 8, startup: int = 16, best_share: float = 0.15,
    candidates: int = 24, low: float = 0.3, high: float = 0.7, seed: int = 42,
) -> DataFrame:
    """Weights in [0, 1] and a threshold in [low, high] by a tree of Parzen estimators: trial, weights, threshold, f2, best first.

    The first ``startup`` trials are drawn evenly.  After that the trials so far are parted into the best
    share (25 at most) and the rest, each a mixture of Gaussians and one even part in every dimension, and
    of ``candidates`` draws from the first the one with the greatest ratio of densities is tried.  ``together`` trials are proposed
    and scored in one pass over the scores; the driver holds the trials only.  The same seed gives the
    same trials.
    """
    wide = scores.groupBy("query_id", "doc_id").pivot("model", models).agg(F.first("score")).fillna(0.0, models)
    judged = relevant.select("query_id", "doc_id").distinct()
    wide = wide.join(judged.withColumn("j", F.lit(True)), ["query_id", "doc_id"], "left").select(*models, F.coalesce("j", F.lit(False)).alias("r")).persist()
    rows = parzen_trials(
        lambda asked: _trial_counts(wide, models, asked), judged.count(), models, trials=trials, together=together, startup=startup, best_share=best_share, candidates=candidates, low=low, high=high, seed=seed)
    wide.unpersist()
    return trial_rows(scores.sparkSession, rows)


def trial_rows(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "trial int, weights map<string,double>, threshold double, f2 double").orderBy(F.desc("f2"), "trial")


def parzen_trials(
    count, total: int, models: list[str], *, trials: int = 40, together: int = 8, startup: int = 16, best_share: float = 0.15, candidates: int = 24, low: float = 0.3, high: float = 0.7, seed: int = 42,
) -> list[tuple]:
    """The trials of ``parzen_search``; ``count(trials)`` gives (hits, predicted) of each (weights, threshold), ``total`` is the number of relevant pairs."""
    draw, dims = np.random.default_rng(seed), len(models) + 1
    points, values = np.zeros((0, dims)), np.zeros(0)

    def density(x: np.ndarray, centres: np.ndarray, width: np.ndarray) -> np.ndarray:
        """Log density of the rows of x: Gaussians at the centres and one even part, by dimension."""
        z = (x[:, None, :] - centres) / width
        each = np.exp(-0.5 * z * z) / (width * np.sqrt(2 * np.pi))
        return np.log((each.sum(axis=1) + 1.0) / (len(centres) + 1)).sum(axis=1)

    while len(values) < trials:
        n = min(together, trials - len(values))
        if len(values) < startup:
            new = draw.random((n, dims))
        else:
            order = np.lexsort((np.arange(len(values)), -values))
            good, rest = np.split(points[order], [min(max(2, round(best_share * len(values))), 25)])
            widths = [np.maximum(x.std(axis=0) * len(x) ** -0.2, 0.1) for x in (good, rest)]
            new = np.zeros((n, dims))
            for i in range(n):
                at = draw.integers(0, len(good) + 1, candidates)
                near = good[np.minimum(at, len(good) - 1)] + draw.normal(size=(candidates, dims)) * widths[0]
                x = np.where((at == len(good))[:, None], draw.random((candidates, dims)), near)
                x = np.clip(1 - np.abs(1 - np.abs(x)), 0, 1)  # back from the borders
                new[i] = x[np.argmax(density(x, good, widths[0]) - density(x, rest, widths[1]))]
        asked = [([float(w) for w in p[:-1].round(6)], float(round(low + (high - low) * p[-1], 6))) for p in new]
        found = [5 * hits / (4 * total + predicted) if hits else 0.0 for hits, predicted in count(asked)]
        points, values = np.concatenate((points, new)), np.concatenate((values, found))
    return [(i, {m: float(w) for m, w in zip(models, p[:-1].round(6), strict=True)}, float(round(low + (high - low) * p[-1], 6)), float(v)) for i, (p, v) in enumerate(zip(points, values, strict=True))]


def dimension_summary(rows: DataFrame, label: str, vector: str = "embedding") -> DataFrame:
    """Mean of each component by label and the spread of the means: which dimensions tell labels apart."""
    parts = rows.select(label, F.posexplode(vector).alias("dim", "x")).groupBy(label, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    return parts.groupBy("dim").agg((F.max("mean") - F.min("mean")).alias("spread"), F.stddev_pop("mean").alias("deviation"))
