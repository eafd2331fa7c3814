"""Boosted symmetric trees for ranking: gradient histograms on Spark, one pass over the rows a level.

Features are cut into bins at their quantiles.  A level of a tree has one split, (feature, bin), for all
of its nodes, so a tree of depth d is d splits and 2^d leaves.  For each level every partition sums the
gradients and Hessians of its rows by node, feature and bin; the sums are combined before and in the
shuffle, and nodes * features * bins of them, whatever the number of rows, come back.  Margins are
worked out anew from the trees so far, which are small, so no state is kept with the rows.

Rows weigh in by a column, which is how positives are oversampled without copies.  Null and not-a-number
features count as below all others.  Equal gains go to the first feature, then the first bin.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Boosting:
    trees: int = 30
    depth: int = 4
    rate: float = 0.3
    bins: int = 32
    l2: float = 1.0
    least_gain: float = 1e-6


@dataclass(frozen=True)
class Tree:
    """Row x is in leaf sum of 2^i for the splits i = (feature, bin) with x's bin of that feature above the bin."""

    splits: tuple[tuple[int, int], ...]
    leaves: tuple[float, ...]


@dataclass(frozen=True)
class Ensemble:
    edges: tuple[tuple[float, ...], ...]  # of each feature; bin b holds values above edge b - 1 and up to edge b
    base: float
    trees: tuple[Tree, ...] = field(default=())

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for tree in self.trees:
            out += np.array(tree.leaves)[nodes(bins, tree.splits)]
        return out

    def score(self, features: Column) -> Column:
        """The probability of label 1, of an array column; built-in expressions only."""
        margin = F.lit(self.base)
        for tree in self.trees:
            leaf = F.lit(0)
            for i, (feature, b) in enumerate(tree.splits):
                x = F.get(features, feature)
                above = x.isNotNull() & ~F.isnan(x) & (x > self.edges[feature][b])
                leaf = leaf + F.when(above, 1 << i).otherwise(0)
            margin = margin + F.get(F.array(*[F.lit(x) for x in tree.leaves]), leaf)
        return 1 / (1 + F.exp(-margin))


def nodes(bins: np.ndarray, splits) -> np.ndarray:
    out = np.zeros(len(bins), dtype=np.int64)
    for i, (feature, b) in enumerate(splits):
        out |= (bins[:, feature] > b).astype(np.int64) << i
    return out


def quantile_edges(rows: DataFrame, features: str, bins: int) -> tuple[tuple[float, ...], ...]:
    """Up to bins - 1 distinct edges of each feature: features * bins numbers."""
    parts = rows.select(F.posexplode(features).alias("i", "x")).select("i", F.col("x").cast("double").alias("x")).filter("x is not null and not isnan(x)")
    found = parts.groupBy("i").agg(F.percentile_approx("x", [j / bins for j in range(1, bins)], 10_000).alias("edges"), F.max("x").alias("most"))
    by = {r["i"]: (r["edges"], r["most"]) for r in found.collect()}
    width = max(by, default=-1) + 1
    return tuple(tuple(sorted({e for e in by[i][0] if e < by[i][1]})) if i in by else () for i in range(width))


def binned(values: np.ndarray, edges) -> np.ndarray:
    out = np.zeros(values.shape, dtype=np.uint8)
    for i, e in enumerate(edges):
        x = values[:, i]
        out[:, i] = np.where(np.isnan(x), 0, np.searchsorted(np.array(e), x, side="left"))
    return out


def best_split(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[float, int, int]:
    """(gain, feature, bin) of the best common split of ``g, h(node, feature, bin)``."""
    left_g, left_h = g.cumsum(axis=2)[:, :, :-1], h.cumsum(axis=2)[:, :, :-1]
    all_g, all_h = g.sum(axis=2)[:, :, None], h.sum(axis=2)[:, :, None]
    gain = left_g**2 / (left_h + l2) + (all_g - left_g) ** 2 / (all_h - left_h + l2) - all_g**2 / (all_h + l2)
    gain = gain.sum(axis=0).round(9)
    if not gain.size:
        return 0.0, 0, 0
    at = int(gain.argmax())
    return float(gain.flat[at]), at // gain.shape[1], at % gain.shape[1]


def fit(rows: DataFrame, features: str = "features", label: str = "label", weight: str | None = None, params: Boosting = Boosting()) -> Ensemble:
    """Logistic loss over ``rows``; ``features`` is an array of numbers of one length."""
    edges = quantile_edges(rows, features, params.bins)
    width, bins = len(edges), params.bins

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values = np.array([[np.nan if x is None else x for x in v] for v in pdf["f"]], dtype=np.float64).reshape(len(pdf), width)
            yield pd.DataFrame({"y": pdf["y"], "w": pdf["w"], "bins": [r.tobytes() for r in binned(values, edges)]})

    small = rows.select(F.col(label).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), F.col(features).cast("array<double>").alias("f"))
    small = small.mapInPandas(cut, "y double, w double, bins binary").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        first = small.agg(F.sum(F.col("w") * F.col("y")).alias("p"), F.sum("w").alias("n")).first()
        share = min(max((first["p"] or 0.0) / first["n"], 1e-6), 1 - 1e-6) if first["n"] else 0.5
        model = Ensemble(edges, float(np.log(share / (1 - share))))
        for _ in range(params.trees if width else 0):
            tree = grown(lambda splits: _histograms(small, model, splits, width, bins), params)  # noqa: B023
            if tree is None:
                break
            model = replace(model, trees=(*model.trees, tree))
        return model
    finally:
        small.unpersist()


def grown(histograms: Callable, params: Boosting) -> Tree | None:
    """A tree by ``histograms(splits)``: sums of gradients and Hessians (node, feature, bin)."""
    splits: list[tuple[int, int]] = []
    leaf_g = leaf_h = np.zeros(1)
    for _ in range(params.depth):
        g, h = histograms(tuple(splits))
        gain, feature, b = best_split(g, h, params.l2)
        if gain < params.least_gain:
            break
        # bit i of a leaf's number is split i: those above go to the second half
        low = [x[:, feature, : b + 1].sum(axis=1) for x in (g, h)]
        high = [x[:, feature, b + 1 :].sum(axis=1) for x in (g, h)]
        leaf_g, leaf_h = (np.concatenate(pair) for pair in zip(low, high, strict=True))
        splits.append((feature, b))
    if not splits:
        return None
    return Tree(tuple(splits), tuple(float(x) for x in -params.rate * leaf_g / (leaf_h + params.l2)))


def _histograms(small: DataFrame, model: Ensemble, splits, width: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of gradients and Hessians (node, feature, bin) of the rows."""
    shape = (1 << len(splits), width, bins)
    cells = int(np.prod(shape))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, cells))
        for pdf in batches:
            b = np.frombuffer(b"".join(pdf["bins"]), dtype=np.uint8).reshape(len(pdf), width)
            y, w = pdf["y"].to_numpy(), pdf["w"].to_numpy()
            p = 1 / (1 + np.exp(-model.margins(b)))
            cell = ((nodes(b, splits)[:, None] * width + np.arange(width)) * bins + b).ravel()
            for k, value in enumerate((w * (p - y), w * p * (1 - p))):
                sums[k] += np.bincount(cell, weights=np.repeat(value, width), minlength=cells)
        used = np.flatnonzero(sums.any(axis=0))
        yield pd.DataFrame({"cell": used, "g": sums[0, used], "h": sums[1, used]})

    out = np.zeros((2, cells))
    found = small.mapInPandas(run, "cell long, g double, h double").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()  # cells rows at most
    out[0, found["cell"]], out[1, found["cell"]] = found["g"], found["h"]
    return out[0].reshape(shape), out[1].reshape(shape)
