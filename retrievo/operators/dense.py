"""Exact vector search and the figures of embedding tables.

Queries are blocks against all rows: the query side is broadcast after a look at its size; each
partition keeps its k best before anything is shuffled.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrievo.functions.vectors import dot, norm, unit
from retrievo.operators import grid
from retrievo.operators.ranking import top_k

#: Query vectors that may be broadcast at once.
BLOCK = 20_000


def paired(queries: DataFrame, docs: DataFrame, exclude_self: bool = True) -> DataFrame:
    """Rows of ``docs(doc_id, ...)`` with each of ``queries(query_id, ...)``: a block of queries is broadcast at a time."""
    meet = F.col("query_id") != F.col("doc_id") if exclude_self else F.lit(True)
    blocks = max(1, -(-queries.count() // BLOCK))
    number = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    parts = [docs.join(F.broadcast(queries if blocks == 1 else queries.filter(number == i)), meet) for i in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def search(queries: DataFrame, docs: DataFrame, k: int, similarity=dot, exclude_self: bool = True) -> DataFrame:
    """query_id, doc_id, rank, score of ``queries(query_id, q)`` against ``docs(doc_id, d)``."""
    if similarity is dot and exclude_self:
        return top_k(grid.top(queries.select("query_id", "q"), docs.select("doc_id", "d"), k), k)
    pairs = paired(queries, docs, exclude_self)
    return top_k(pairs.select("query_id", "doc_id", similarity(F.col("q"), F.col("d")).alias("score")), k)


def merged_shards(found: DataFrame, k: int) -> DataFrame:
    """Global top-k from the top-k of each shard."""
    return top_k(found, k)


def pooled(rows: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Mean vector of each key, component by component."""
    parts = rows.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return parts.groupBy(key).agg(listed.alias(vector))


def l1_range(pairs: DataFrame) -> Column:
    """Upper end of the calibrated histogram range: 1.1 times the greatest component difference."""
    return F.max(F.aggregate(F.zip_with("q", "d", lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda m, x: F.greatest(m, x))) * 1.1


def difference_histogram(pairs: DataFrame, bins: int, upper: float) -> DataFrame:
    """Counts of |q_i - d_i| in equal bins of [0, upper]; the last bin is closed, values beyond are dropped."""
    diffs = pairs.select("query_id", "doc_id", F.explode(F.zip_with("q", "d", lambda a, b: F.abs(a.cast("double") - b.cast("double")))).alias("x")).filter(F.col("x") <= upper)
    bin_ = F.least(F.floor(F.col("x") / F.lit(upper / bins)), F.lit(bins - 1)).cast("int")
    return diffs.withColumn("bin", bin_).groupBy("query_id", "doc_id", "bin").agg(F.count(F.lit(1)).alias("n"))


def separability(scores: DataFrame) -> DataFrame:
    """(mean relevant - mean other) / (their deviations) over ``scores(score, relevant)``."""
    r, n = F.when(F.col("relevant"), F.col("score")), F.when(~F.col("relevant"), F.col("score"))
    gap = F.avg(r) - F.avg(n)
    return scores.agg(F.avg(r).alias("mean_relevant"), F.avg(n).alias("mean_other"), gap.alias("gap"), (gap / (F.stddev_pop(r) + F.stddev_pop(n))).alias("separability"))


def neighbourhood_coverage(neighbours: DataFrame, groups: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """For ``groups(group_id, doc_id)``: the mean share of a document's group mates among its neighbours.

    ``asked(doc_id)`` are the documents that neighbours were looked for, by default all.  Only neighbours
    meet their groups, mates are counted.
    """
    mates = groups.groupBy("group_id").agg((F.count(F.lit(1)) - 1).alias("mates")).filter("mates > 0")
    of = groups if asked is None else groups.join(asked, "doc_id", "left_semi")
    of = of.join(mates, "group_id").withColumnRenamed("doc_id", "query_id")
    hits = neighbours.select("query_id", "doc_id").join(groups, "doc_id").groupBy("query_id", "group_id").agg(F.count(F.lit(1)).alias("hits"))
    share = F.coalesce("hits", F.lit(0)) / F.col("mates")
    return of.join(hits, ["query_id", "group_id"], "left").groupBy("group_id").agg(F.avg(share).alias("coverage"))


def mean_distance(rows: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Mean cosine distance of the pairs of a group without making pairs: 1 - (|sum|^2 - n) / (n (n - 1))."""
    parts = rows.select(key, unit(F.col(vector)).alias("u")).select(key, F.posexplode("u").alias("i", "x"))
    sums = parts.groupBy(key, "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.groupBy(key).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("sq")).select(key, "n", (1 - (F.col("sq") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("distance"))


def collapse(rows: DataFrame, vector: str = "embedding") -> dict[str, float]:
    """Effective ranks, spectral entropy and top variances, from the Gram matrix of the components."""
    parts = rows.select(F.monotonically_increasing_id().alias("r"), vector).select("r", F.posexplode(vector).alias("i", "x"))
    mean = parts.groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centred = parts.join(F.broadcast(mean), "i").select("r", "i", (F.col("x") - F.col("m")).alias("x"))  # a row per component
    wide = centred.groupBy("r").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    pairs = wide.select(F.posexplode("v").alias("i", "x"), "v").select("i", "x", F.posexplode("v").alias("j", "y")).filter("i <= j")
    gram = pairs.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("g")).collect()  # dim * dim / 2 rows
    dim = 1 + max((r["j"] for r in gram), default=0)
    m = np.zeros((dim, dim))
    for r in gram:
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["g"]
    values = np.maximum(np.linalg.eigvalsh(m)[::-1], 0)
    share = values / max(values.sum(), 1e-300)
    upto = np.cumsum(share)
    positive = share[share > 0]
    return {f"rank_{p}": int((upto < p / 100).sum() + 1) for p in (90, 95, 99)} | {"entropy": float(-(positive * np.log(positive)).sum()), "top_1": float(share[0]), "top_10": float(upto[min(9, dim - 1)])}


def kmeans(rows: DataFrame, k: int, seed: int = 42, vector: str = "embedding") -> DataFrame:
    """Cluster of each row by Spark's k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    return KMeans(k=k, seed=seed, initSteps=5).fit(data).transform(data).drop("features").withColumnRenamed("prediction", "cluster")


def kmeans_starts(rows: DataFrame, k: int, starts: int = 10, seed: int = 42, rounds: int = 50, id_col: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, dict[int, float]]:
    """Lloyd's k-means from several starts, all advanced in one pass over the rows a round.

    Returns the rows with ``cluster`` of the start of least inertia, and the inertia of each start.  A
    start begins with the k rows of least hash of id and start.  Partitions hand on sums of starts * k
    vectors, which are combined in the shuffle; a start that no longer moves takes no part in later
    rounds.  An empty cluster keeps its centre; a row's ties go to the lower cluster.
    """
    data = rows.select(F.col(vector).cast("array<double>").alias("v"))
    matrix = lambda column: np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)
    order = F.xxhash64(F.col(id_col).cast("string"), F.lit(seed) + F.col("start"))
    tried = rows.select(id_col, F.explode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("start"))
    drawn = tried.withColumn("place", F.row_number().over(Window.partitionBy("start").orderBy(order, id_col))).filter(F.col("place") <= k)
    drawn = drawn.join(rows.select(id_col, F.col(vector).cast("array<double>").alias("v")), id_col).dropDuplicates(["start", "place"]).collect()  # starts * k rows
    centres = {start: np.array([r["v"] for r in sorted((r for r in drawn if r["start"] == start), key=lambda r: r["place"])]) for start in range(starts)}
    centres = {start: c for start, c in centres.items() if len(c) == k}
    if not centres:
        raise ValueError(f"fewer than {k} rows")

    def near(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)

    def advanced(now: dict) -> tuple[dict, dict]:
        names, dim = sorted(now), next(iter(now.values())).shape[1]

        def run(batches):
            sums, spread = np.zeros((len(names), k, dim + 1)), np.zeros(len(names))
            for pdf in batches:
                x = matrix(pdf["v"])
                for i, name in enumerate(names):
                    d = near(x, now[name])
                    at = d.argmin(axis=1)
                    spread[i] += np.maximum(d[np.arange(len(x)), at], 0).sum()
                    np.add.at(sums[i], at, np.column_stack((x, np.ones(len(x)))))
            cells = np.concatenate((sums.ravel(), spread))
            yield pd.DataFrame({"cell": np.arange(len(cells)), "x": cells})

        found = data.mapInPandas(run, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).orderBy("cell").toPandas()["x"].to_numpy()  # starts * k * dim numbers
        sums, spread = found[: -len(names)].reshape(len(names), k, dim + 1), found[-len(names) :]
        count = sums[:, :, -1:]
        return {n: np.where(count[i] > 0, sums[i, :, :-1] / np.maximum(count[i], 1), now[n]) for i, n in enumerate(names)}, dict(zip(names, spread, strict=True))

    moving, inertia = dict(centres), {}
    for _ in range(rounds):
        moved, spread = advanced(moving)
        inertia |= spread
        moving = {n: c for n, c in moved.items() if np.abs(c - centres[n]).max() > 1e-9}
        centres |= moving
        if not moving:
            break
    else:
        inertia |= advanced(moving)[1]
    best = min(inertia, key=lambda n: (round(inertia[n], 9), n))
    chosen = centres[best]

    @F.pandas_udf("int")
    def cluster(v: pd.Series) -> pd.Series:
        return pd.Series(near(matrix(v), chosen).argmin(axis=1))

    return rows.withColumn("cluster", cluster(F.col(vector).cast("array<double>"))), inertia


def contranorm(rows: DataFrame, key: str, id_col: str, vector: str = "embedding", scale: float = 0.5, tau: float = 1.0, block: int = 1024, eps: float = 1e-5) -> DataFrame:
    """``vector`` of each row pushed away from its like in the group ``key`` and normalised: (1 + scale) x - scale * softmax(cos / tau) x, then
    to mean 0 and variance 1 (with ``eps``, no learned factors).  ``id_col`` tells the rows of a group apart.

    A group is cut into parts of about ``block`` rows; each two parts meet in one task, which hands on a
    denominator and a vector for each row, so a large group is many tasks.  Cosines are at most 1, so the
    exponentials need no common maximum and sums of parts add up.
    """
    plain = rows.select(F.col(key).alias("g"), F.col(id_col).alias("r"), F.col(vector).cast("array<double>").alias("x"))
    parts = plain.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts")).withColumnRenamed("g", "h")
    dealt = plain.join(parts, F.col("g").eqNullSafe(F.col("h"))).select("g", "r", "x", "parts", F.pmod(F.xxhash64("r"), F.col("parts")).cast("int").alias("home"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = dealt.select("g", "r", "x", F.col("home").alias("i"), every.alias("j"))
    right = dealt.select(F.col("g").alias("h"), F.col("x").alias("y"), every.alias("p"), F.col("home").alias("q"))
    kinds = dict(plain.dtypes)

    def unit_rows(x):
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def met(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["g", "r", "below", "above"])
        x, y = (np.array(c.tolist()) for c in (a["x"], b["y"]))
        w = np.exp(unit_rows(x) @ unit_rows(y).T / tau)
        return pd.DataFrame({"g": a["g"], "r": a["r"], "below": w.sum(axis=1), "above": list(w @ y)})

    sums = left.groupBy("g", "i", "j").cogroup(right.groupBy("h", "p", "q")).applyInPandas(met, f"g {kinds['g']}, r {kinds['r']}, below double, above array<double>")
    zero = F.transform(F.element_at(F.collect_list("above"), 1), lambda v: F.lit(0.0))
    total = F.aggregate(F.collect_list("above"), zero, lambda s, v: F.zip_with(s, v, lambda p, q: p + q))
    mean = sums.groupBy("g", "r").agg(F.sum("below").alias("below"), total.alias("above")).withColumnsRenamed({"g": "h", "r": "s"})
    both = plain.join(mean, F.col("g").eqNullSafe(F.col("h")) & (F.col("r") == F.col("s")))

    def finished(batches):
        for pdf in batches:
            x, above = (np.array(c.tolist(), dtype=np.float64).reshape(len(pdf), -1) for c in (pdf["x"], pdf["above"]))
            x = (1 + scale) * x - scale * above / pdf["below"].to_numpy()[:, None]
            x = (x - x.mean(axis=1, keepdims=True)) / np.sqrt(x.var(axis=1, keepdims=True) + eps)
            yield pd.DataFrame({key: pdf["g"], id_col: pdf["r"], vector: list(x)})

    return both.select("g", "r", "x", "below", "above").mapInPandas(finished, f"{key} {kinds['g']}, {id_col} {kinds['r']}, {vector} array<double>")


def accepted_queries(rows: DataFrame, limit: float = 0.92) -> DataFrame:
    """Rows (conv_id, turn, v) in order; one is accepted unless it is too similar to an accepted one before."""
    def fold(pdf):
        pdf = pdf.sort_values("turn")
        kept, flags = [], []
        for v in pdf["v"]:
            v = np.asarray(v, dtype=float)
            ok = not kept or float(np.max(np.stack(kept) @ v)) <= limit
            flags.append(ok)
            if ok:
                kept.append(v)
        return pdf.assign(accepted=flags)[["conv_id", "turn", "accepted"]]

    return rows.groupBy("conv_id").applyInPandas(fold, "conv_id long, turn long, accepted boolean")


def attention(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One step of message passing: softmax of edge scores over each target, weighted sum, residual.

    ``nodes(id, x)``, ``edges(src, dst, score)``; targets without edges keep their vector.
    """
    top = Window.partitionBy("dst")
    weight = F.exp(F.col("score") - F.max("score").over(top))
    shared = edges.withColumn("w", weight).withColumn("w", F.col("w") / F.sum("w").over(top))
    sent = shared.join(nodes.select(F.col("id").alias("src"), "x"), "src").select("dst", "w", F.posexplode("x").alias("i", "v"))
    summed = sent.groupBy("dst", "i").agg(F.sum(F.col("w") * F.col("v")).alias("m")).groupBy("dst").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    return nodes.join(summed, nodes["id"] == summed["dst"], "left").select("id", F.when(F.col("m").isNull(), F.col("x")).otherwise(F.zip_with("x", "m", lambda a, b: a + b)).alias("x"))


def drift(centroids: DataFrame, reference: str, other: str, target: str) -> DataFrame:
    """Cosines of the target split's centroid with those of two others."""
    c = {s: centroids.filter(F.col("split") == s).select(F.col("embedding").alias(s)) for s in (reference, other, target)}
    cos = lambda a, b: dot(F.col(a), F.col(b)) / (norm(F.col(a)) * norm(F.col(b)))
    row = c[reference].join(F.broadcast(c[other])).join(F.broadcast(c[target]))  # one row each
    return row.select(cos(target, reference).alias("to_reference"), cos(target, other).alias("to_other"))
