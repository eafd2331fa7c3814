"""Operator 13: hard negatives by bit-sliced integer products.

A component x becomes the integer floor(256 x); a score is the integer product of two rows.  Rows are
dealt to parts of about ``chunk``, anchors to lots of about ``lot``; every lot meets every part once for
the positives and once, with the scores of its positives, for the negatives.  So a task holds a lot and
a part, whatever the table's size, and hands on no more than the first ``positives`` or ``negatives``
rows of an anchor or of a positive.

Inside such a block the components of the part are cut into bit planes.  Planes are multiplied with the
anchors most significant first; after each, the score of every candidate lies in an interval that halves
with the next plane.  Candidates whose interval can't qualify any more are dropped: for positives, those
below the k-th greatest lower end; for negatives, those outside the ranges of all positives or behind
enough rows that surely are inside.  Once few are left, only their planes are read.  Products are exact:
doubles below 2^53, else Python's integers.

Defined cases: rows with a null vec_id, label or vector, or with null or non-finite components take no
part, nor do vectors of another length than the table's most common one, nor rows whose squared length
reaches 2^62, since their scores may not fit a long; rows that share a vec_id are candidates of their
own, also for the anchor of that id, which is the one with the least components, label and row; equal
scores come by vec_id, then by row; positives with a negative score have no negatives; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retrievo.llm.storage import materialize

SCALE = 256
#: Negatives have at least so many hundredths of the positive's score.
LEAST = 80
#: Candidates of a block are read one by one once fewer than one in so many are left.
FEW = 32


def integers(column: pd.Series) -> np.ndarray:
    return np.floor(SCALE * np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1))


class Sliced:
    """The bit planes of a block of vectors, most significant first, and products with them."""

    def __init__(self, vectors: np.ndarray):
        whole = vectors.astype(np.int64)
        most = int(np.abs(whole).max(initial=0))
        self.width = most.bit_length() + 1  # components are below 2^(width - 1) in absolute value
        self.most, self.shifted = most, whole + (1 << (self.width - 1))

    def plane(self, i: int, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        return (self.shifted[rows] >> i) & 1

    def intervals(self, anchors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of anchors, rows of candidates, and the lower and upper ends of their scores, after each plane.

        The caller sends back which of the pairs stay.
        """
        exact = 2 * anchors.shape[1] * max(1.0, float(np.abs(anchors).max(initial=0))) * 2.0**self.width < 2.0**53
        kind = np.float64 if exact else object
        q = anchors.astype(kind) if exact else np.array([[int(x) for x in row] for row in anchors], dtype=object).reshape(anchors.shape)
        low, high = np.minimum(q, 0).sum(axis=1), np.maximum(q, 0).sum(axis=1)
        m, n = len(anchors), len(self.shifted)
        sums = np.tile((-(1 << (self.width - 1)) * q.sum(axis=1))[:, None], (1, n)).astype(kind)
        stays = np.ones((m, n), dtype=bool)
        i, a, c = self.width - 1, None, None
        while i >= 0 and stays.sum() * FEW > m * n:  # all pairs at once
            sums += (1 << i) * (q @ self.plane(i).astype(kind).T)
            rest = (1 << i) - 1
            # while sums are closer together than intervals are wide nothing is ruled out
            if not rest or (sums.max(axis=1) - sums.min(axis=1) > rest * (high - low)).any():
                a, c = np.nonzero(stays)
                keep = yield a, c, sums[a, c] + rest * low[a], sums[a, c] + rest * high[a]
                stays[a[~keep], c[~keep]] = False
            i -= 1
        a, c = np.nonzero(stays)
        left = sums[a, c]
        while i >= 0:  # pair by pair
            add = [(q[a[k : k + 8192]] * self.plane(i, c[k : k + 8192])).sum(axis=1) for k in range(0, len(a), 8192)]
            left = left + (1 << i) * np.concatenate(add) if add else left
            rest = (1 << i) - 1
            keep = yield a, c, left + rest * low[a], left + rest * high[a]
            a, c, left = a[keep], c[keep], left[keep]
            i -= 1


def greatest(owner: np.ndarray, value: np.ndarray, owners: int, k: int) -> np.ndarray:
    """Of each owner's values the k-th greatest; minus infinity if there are fewer.  ``owner`` ascends."""
    counts = np.bincount(owner, minlength=owners)
    table = np.full((owners, max(k, counts.max(initial=0))), -np.inf, dtype=value.dtype)
    table[owner, np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]] = value
    return np.sort(table, axis=1)[:, -k] if value.dtype == object else np.partition(table, -k, axis=1)[:, -k]


def best(rows: Sliced, anchors: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of what may be among the k rows of greatest score; ``allowed`` by anchor and row."""
    walk, keep = rows.intervals(anchors), None
    a = c = score = np.zeros(0, dtype=np.int64)
    while True:
        try:
            a, c, lower, upper = walk.send(keep)
        except StopIteration:
            return a[keep], c[keep], score[keep]
        keep, score = allowed[a, c], lower
        bound = greatest(a[keep], lower[keep], len(anchors), k)
        keep &= (upper >= bound[a]).astype(bool)


def within(rows: Sliced, anchors: np.ndarray, ranges: list[list[tuple[int, int]]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of what may be among the k rows of greatest score in one of an anchor's ``ranges`` (least, most)."""
    depth = max(map(len, ranges), default=0)
    # an empty range where an anchor has fewer
    least, most = (np.array([[r[p][e] if p < len(r) else (1, 0)[e] for p in range(depth)] for r in ranges], dtype=object).reshape(len(ranges), depth) for e in (0, 1))
    if max((abs(x) for r in ranges for pair in r for x in pair), default=0) < 2**53:
        least, most = least.astype(np.float64), most.astype(np.float64)
    walk, keep = rows.intervals(anchors), None
    a = c = score = np.zeros(0, dtype=np.int64)
    while True:
        try:
            a, c, lower, upper = walk.send(keep)
        except StopIteration:
            return a[keep], c[keep], score[keep]
        keep, score = np.zeros(len(a), dtype=bool), lower
        for p in range(depth):
            low, high = least[a, p], most[a, p]
            near = (low <= high) & (upper >= low) & (lower <= high)
            near = near.astype(bool)
            sure = near & ((lower >= low) & (upper <= high)).astype(bool)
            bound = greatest(a[sure], lower[sure], len(anchors), k)
            keep |= near & (upper >= bound[a]).astype(bool)


def firsts(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Positions of each owner's first k by score, id and row."""
    order = np.lexsort((row, ids, -score, owner))
    starts = np.searchsorted(owner[order], owner[order], side="left")
    return order[np.arange(len(order)) - starts < k]


def mine(vectors: DataFrame, *, every: int = 100, positives: int = 5, negatives: int = 5, chunk: int = 2048, lot: int = 1024) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score: for every anchor (ids divisible by ``every``)
    and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of other labels that score no more,
    and at least LEAST hundredths of it."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.pow(F.abs(SCALE * x.cast("double")) + 1, F.lit(2)))
    rows = vectors.select("vec_id", "embedding", F.col("label").cast("long").alias("label")).filter("vec_id is not null and label is not null and embedding is not null")
    rows = rows.filter(finite).filter(squares < 2.0**62)
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim, total = (common["n"], common["count"]) if common else (0, 0)
    rows = materialize(rows.filter(F.size("embedding") == dim).withColumn("row", F.monotonically_increasing_id()), "negatives-rows")
    anchors = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("embedding", "label", "row")).alias("r"))
    anchors = materialize(anchors.select(F.col("vec_id").alias("anchor_id"), "r.embedding", "r.label", "r.row"), "negatives-anchors")
    parts, lots = -(-max(total, 1) // chunk), -(-max(anchors.count(), 1) // lot)

    def met(asking: DataFrame, block, schema: str) -> DataFrame:
        left = asking.withColumn("lot", F.pmod(F.xxhash64("anchor_id"), F.lit(lots))).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        right = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")).withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))).withColumn("lot", F.col("lot").cast("long"))
        return left.groupBy("lot", "part").cogroup(right.groupBy("lot", "part")).applyInPandas(block, schema)

    def blocks(left: pd.DataFrame, right: pd.DataFrame, same: bool):
        """By label: the anchors, the rows of the same or of another label, ids and row numbers of these."""
        if not len(left) or not len(right) or not dim:
            return
        labels, own = right["label"].to_numpy(), left["label"].to_numpy()
        asking, offered = integers(left["embedding"]), integers(right["embedding"])
        for label in np.unique(own):
            pick = np.flatnonzero((labels == label) == same)
            if len(pick):
                at = np.flatnonzero(own == label)
                yield left.iloc[at], asking[at], Sliced(offered[pick]), right["vec_id"].to_numpy()[pick], right["row"].to_numpy()[pick]

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for some, asking, sliced, ids, numbers in blocks(left, right, True):
            a, c, score = best(sliced, asking, numbers[None, :] != some["row"].to_numpy()[:, None], positives)
            score = score.astype(np.int64)
            pick = firsts(a, score, ids[c], numbers[c], positives)
            out.append(pd.DataFrame({"anchor_id": some["anchor_id"].to_numpy()[a[pick]], "vec_id": ids[c[pick]], "score": score[pick], "row": numbers[c[pick]]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["anchor_id", "vec_id", "score", "row"])

    def hard(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names, out = ["anchor_id", "positive_score", "vec_id", "score", "row"], []
        for some, asking, sliced, ids, numbers in blocks(left, right, False):
            ranges = [[(-(-LEAST * int(s) // 100), int(s)) for s in scores if s >= 0] for scores in some["scores"]]
            a, c, score = within(sliced, asking, ranges, negatives)
            score, who = score.astype(np.int64), some["anchor_id"].to_numpy()
            for p in range(max(map(len, ranges), default=0)):
                least, most = (np.array([r[p][e] if p < len(r) else (1, 0)[e] for r in ranges], dtype=np.int64) for e in (0, 1))
                inside = np.flatnonzero((score >= least[a]) & (score <= most[a]))
                pick = inside[firsts(a[inside], score[inside], ids[c[inside]], numbers[c[inside]], negatives)]
                out.append(pd.DataFrame(dict(zip(names, (who[a[pick]], most[a[pick]], ids[c[pick]], score[pick], numbers[c[pick]]), strict=True))))
        return pd.concat(out) if out else pd.DataFrame(columns=names)

    anchors = anchors.select("anchor_id", "embedding", "label", "row")
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "row"))
    found = met(anchors, nearest, "anchor_id long, vec_id long, score long, row long").withColumn("rank", rank("anchor_id")).filter(F.col("rank") <= positives)
    found = materialize(found.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("row").alias("positive_row")), "negatives-positives")
    asking = anchors.join(found.groupBy("anchor_id").agg(F.collect_set("positive_score").alias("scores")), "anchor_id")
    rest = met(asking, hard, "anchor_id long, positive_score long, vec_id long, score long, row long")
    rest = rest.withColumn("rank", rank("anchor_id", "positive_score")).filter(F.col("rank") <= negatives)
    rest = rest.select("anchor_id", "positive_score", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(rest, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_row")


#: The query's rows by all products of anchors and rows.
SQL = r"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""
