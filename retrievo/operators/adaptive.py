"""Graph-adaptive re-ranking: batches alternate between a first-stage pool and the neighbours found so far.

A query's loop is short (budget / batch rounds) and sees its own candidates only, so queries run as
groups.  Scores of all documents that the loop can reach are an input: rows (query_id, doc_id,
score) of the pool and of nodes within as many hops as there are rounds, or any superset of them.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Container, Iterable, Iterator, Sized
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Plan:
    budget: int = 100
    batch: int = 16
    graph_k: int | None = None
    backfill: bool = True
    affinity: bool = False  # frontier by summed edge weight * softmax of the parent, not by its score
    top_s: int = 10


class Candidates:
    """A queue by priority, raised by putting a document again; equal priorities come in the order of arrival.

    Entries of the heap that a later one replaced are skipped when they come up.
    """

    def __init__(self, items: Iterable[tuple] = ()):
        self.priority: dict = {}
        self.arrival: dict = {}
        self.heap: list[tuple] = []
        for doc, priority in items:
            self.put(doc, priority)

    def put(self, doc, priority: float) -> None:
        self.priority[doc] = priority
        heapq.heappush(self.heap, (-priority, self.arrival.setdefault(doc, len(self.arrival)), doc))

    def draw(self, n: int, seen: Container) -> list:
        """Up to n of the best, without those seen."""
        drawn: list = []
        while self.heap and len(drawn) < n:
            key, _, doc = heapq.heappop(self.heap)
            if doc not in seen and self.priority.get(doc) == -key:
                del self.priority[doc]
                drawn.append(doc)
        return drawn


def lots(pool: Candidates, frontier: Candidates, seen: Sized, plan: Plan) -> Iterator[list]:
    """Lots to score: the two sources in turn, the other one where a source has none, until the budget is spent."""
    for sources in itertools.cycle(((pool, frontier), (frontier, pool))):
        room = min(plan.batch, plan.budget - len(seen))
        lot = next(filter(None, (source.draw(room, seen) for source in sources)), None)
        if lot is None:
            return
        yield lot


def strengths(lot: list, scores: dict, plan: Plan) -> dict:
    """What a scored document passes on: its score or, for affinity, its softmax among the best ``top_s`` scored so far."""
    if not plan.affinity:
        return {doc: scores[doc] for doc in lot}
    best = heapq.nsmallest(plan.top_s, scores, key=lambda doc: -scores[doc])
    odds = {doc: math.exp(scores[doc] - scores[best[0]]) for doc in best}
    return {doc: odds[doc] / sum(odds.values()) for doc in lot if doc in odds}


def walk(pool: list[tuple], neighbours, score, plan: Plan) -> list[tuple]:
    """(doc, score) best first, for one query.  ``neighbours(doc)`` gives (doc, weight); ``score(doc)`` a number."""
    first, frontier, scores = Candidates(pool), Candidates(), {}
    for lot in lots(first, frontier, scores, plan):
        scores |= {doc: score(doc) for doc in lot}
        for doc, strength in strengths(lot, scores, plan).items():
            for other, weight in neighbours(doc):
                held = frontier.priority.get(other, 0.0)
                if other not in scores:
                    frontier.put(other, held + weight * strength if plan.affinity else max(held, strength))
    if plan.backfill:  # below all that were scored
        floor = min(scores.values(), default=0.0) - 1
        unscored = first.draw(plan.budget - len(scores), scores)
        scores |= {doc: floor - place for place, doc in enumerate(unscored)}
    return sorted(scores.items(), key=lambda item: -item[1])


def rerank(pool: DataFrame, graph: DataFrame, scores: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """query_id, doc_id, rank, score.

    ``pool(query_id, doc_id, rank, score)``; ``graph(src, dst, nbr_rank, weight)``; ``scores(query_id, doc_id, score)``.
    Documents without a score count as 0.  A query's edges are those of the documents it has scores
    or a pool entry for, so each group holds its own part of the graph.
    """
    limit = F.col("nbr_rank") <= plan.graph_k if plan.graph_k else F.lit(True)
    members = pool.select("query_id", "doc_id").unionByName(scores.select("query_id", "doc_id")).distinct()
    edges = members.join(graph.filter(limit), members["doc_id"] == graph["src"]).select("query_id", "src", "dst", "nbr_rank", "weight")
    schema = "query_id long, kind int, a long, b long, n int, x double"
    rows = pool.select("query_id", F.lit(0).alias("kind"), F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), F.col("rank").alias("n"), F.col("score").alias("x"))
    rows = rows.unionAll(scores.select("query_id", F.lit(1), "doc_id", F.lit(None).cast("long"), F.lit(0), "score"))
    rows = rows.unionAll(edges.select("query_id", F.lit(2), "src", "dst", "nbr_rank", F.col("weight").cast("double")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {k: g.sort_values(["a", "n"]) for k, g in pdf.groupby("kind")}
        none = pdf.iloc[:0]
        first = parts.get(0, none).sort_values("n")
        known = dict(zip(parts.get(1, none)["a"], parts.get(1, none)["x"], strict=True))
        near: dict = {}
        for a, b, x in zip(*(parts.get(2, none)[c] for c in ("a", "b", "x")), strict=True):
            near.setdefault(a, []).append((int(b), x))
        out = walk(list(zip(first["a"], first["x"], strict=True)), lambda d: near.get(d, ()), lambda d: known.get(d, 0.0), plan)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "doc_id": [d for d, _ in out], "rank": range(1, len(out) + 1), "score": [s for _, s in out]})

    return rows.toDF(*[c.split()[0] for c in schema.split(", ")]).groupBy("query_id").applyInPandas(run, "query_id long, doc_id long, rank int, score double")


def expanded(result: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """Mean number of documents among the first k that the pool didn't hold."""
    new = result.filter(F.col("rank") <= k).join(pool, ["query_id", "doc_id"], "left_anti").groupBy("query_id").agg(F.count(F.lit(1)).alias("new"))
    return result.select("query_id").distinct().join(new, "query_id", "left").agg(F.avg(F.coalesce("new", F.lit(0))).alias("expanded"))
