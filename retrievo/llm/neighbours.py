"""Operator 8: approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation is three rounds of random signs and a fast Hadamard transform.  A unit vector's
hash is the signed axis nearest to its rotation; a table joins the hashes of two rotations to one of
4 d^2 buckets.  A query probes the buckets with the greatest sum of nearness in every table; as
neighbours come nearer in a larger table, their number falls with a power of the table's rows.

The index has a row per vector and table.  Buckets with the same first axis, with the queries that
probe one of them, are one task's block; a query meets there the rows of the buckets it probes.
Distances are exact, on the original vectors in double precision, and only the ``k`` best of each
query leave the block, so candidates are never written out as pairs.  A block of over ``chunk``
vectors is dealt to several, and its queries to each of them, so none grows with the input.
Queries that found fewer than ``k`` rows are answered from the whole table, in blocks.

Defined cases: vectors that are null, zero or hold null or non-finite components take no part, nor
do vectors of another length than the table's most common one; repeated rows and rows that share a
vec_id are separate candidates, also for the query of that id (a query is each distinct id once: the
row with the least components, the only one it leaves out); an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retrievo.llm.storage import materialize

SIGNS = 3


def rotations(dim: int, tables: int, seed: int) -> np.ndarray:
    """Random signs: (tables, SIGNS, next power of two of dim)."""
    size = 1 << (dim - 1).bit_length()
    return np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, SIGNS, size))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows of x, orthonormal."""
    n, size = x.shape
    h = 1
    while h < size:
        x = x.reshape(n, size // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, size)
        h *= 2
    return x / np.sqrt(size)


def scores(vectors: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Of each vector's rotation, the nearness to all signed axes."""
    x = np.zeros((len(vectors), signs.shape[1]))
    x[:, : vectors.shape[1]] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for s in signs:
        x = hadamard(x * s)
    return np.concatenate((x, -x), axis=1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def nearest(query: np.ndarray, own: int, rows: np.ndarray, keys: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(key, id, distance) of the k rows nearest to a query, by distance and then id; the row with the key ``own`` is left out."""
    d = np.sqrt(((rows - query) ** 2).sum(axis=1))
    d[keys == own] = np.inf
    pick = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
    pick = pick[np.lexsort((keys[pick], ids[pick], d[pick]))][:k]
    return [(keys[i], ids[i], d[i]) for i in pick if np.isfinite(d[i])]


FOUND = "query_id long, row long, vec_id long, score double"
COLUMNS = ["query_id", "row", "vec_id", "score"]


def search(
    vectors: DataFrame, *, every: int = 100, k: int = 10, tables: int = 16, reach: float = 0.2, fall: float = 0.3, chunk: int = 16384, seed: int = 11,
) -> DataFrame:
    """The k nearest rows to each row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score.

    A query probes a share of ``reach * rows ** -fall`` of the buckets of a table, one at least.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & finite)
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim, total = (common["n"], common["count"]) if common else (1, 0)
    rows = materialize(rows.filter(F.size("embedding") == dim).withColumn("row", F.monotonically_increasing_id()), "ann-rows")
    queries = materialize(
        rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("embedding", "row")).alias("r")).select("vec_id", "r.row", "r.embedding"),
        "ann-queries",
    )
    queries = queries.repartition(F.xxhash64("vec_id"))
    kind = rows.schema["embedding"].dataType.simpleString()

    def index(batches):
        signs = rotations(dim, 2 * tables, seed)
        for pdf in batches:
            if len(pdf):
                m = _matrix(pdf["embedding"])
                for t in range(tables):
                    first, second = (scores(m, signs[2 * t + i]).argmax(axis=1) for i in (0, 1))
                    yield pd.DataFrame({"bucket": t * 2 * signs.shape[2] + first, "second": second, "row": pdf["row"], "vec_id": pdf["vec_id"], "embedding": pdf["embedding"]})

    def probe(batches):
        signs = rotations(dim, 2 * tables, seed)
        width = 2 * signs.shape[2]
        most = min(max(round(width * width * reach * max(total, 1) ** -fall), 1), width * width)
        for whole in batches:
            for at in range(0, len(whole), 16):  # a query has a row for each first axis it probes
                pdf, out = whole.iloc[at : at + 16], []
                m = _matrix(pdf["embedding"])
                for t in range(tables):
                    a, b = (scores(m, signs[2 * t + i]) for i in (0, 1))
                    for i, (vec, row, embedding) in enumerate(zip(pdf["vec_id"], pdf["row"], pdf["embedding"], strict=True)):
                        hit = np.zeros(width * width, dtype=bool)
                        hit[np.argpartition(-(a[i][:, None] + b[i]).ravel(), most - 1)[:most]] = True
                        hit = hit.reshape(width, width)
                        out += [(t * width + first, hit[first].tobytes(), row, vec, embedding) for first in np.flatnonzero(hit.any(axis=1))]
                yield pd.DataFrame(out, columns=["bucket", "seconds", "row", "vec_id", "embedding"])

    indexed = rows.mapInPandas(index, f"bucket int, second int, row long, vec_id long, embedding {kind}")
    sizes = indexed.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))  # 4 * dim * tables rows at most
    sizes = materialize(sizes.select("bucket", F.ceil(F.col("rows") / chunk).cast("int").alias("parts")), "ann-sizes")
    dealt = indexed.join(F.broadcast(sizes), "bucket").withColumn("part", F.pmod(F.xxhash64("row"), "parts").cast("int"))
    probing = queries.mapInPandas(probe, f"bucket int, seconds binary, row long, vec_id long, embedding {kind}").join(F.broadcast(sizes), "bucket")
    probing = probing.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            m, keys, ids, second = _matrix(right["embedding"]), right["row"].to_numpy(), right["vec_id"].to_numpy(), right["second"].to_numpy()
            for vec, own, query, seconds in zip(left["vec_id"], left["row"], _matrix(left["embedding"]), left["seconds"], strict=True):
                pick = np.flatnonzero(np.frombuffer(seconds, dtype=bool)[second])
                if len(pick):
                    out += [(vec, *x) for x in nearest(query, own, m[pick], keys[pick], ids[pick], k)]
        return pd.DataFrame(out, columns=COLUMNS)

    left = probing.select("bucket", "part", "row", "vec_id", "embedding", "seconds").groupBy("bucket", "part")
    right = dealt.select("bucket", "part", "row", "vec_id", "embedding", "second").groupBy("bucket", "part")
    found = materialize(_best(left.cogroup(right).applyInPandas(block, FOUND).distinct(), k), "ann-found")
    enough = found.groupBy("query_id").count().filter(F.col("count") >= min(k, max(0, total - 1)))
    short = queries.join(enough.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    rest = found.join(enough.select("query_id"), "query_id", "left_semi").select(*COLUMNS)
    return _best(rest.unionByName(exact(short, rows, k=k, total=total)), k).drop("row")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id", "row")).alias("rank")
    return found.select("query_id", rank, "vec_id", "score", "row").filter(F.col("rank") <= k)


def exact(queries: DataFrame, rows: DataFrame, *, k: int, total: int, chunk: int = 16384) -> DataFrame:
    """Brute force in blocks: the queries, few by then, meet every part of the rows once."""
    parts = max(1, -(-total // chunk))
    left = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))

    def block(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            m, keys, ids = _matrix(b["embedding"]), b["row"].to_numpy(), b["vec_id"].to_numpy()
            for vec, own, query in zip(a["vec_id"], a["row"], _matrix(a["embedding"]), strict=True):
                out += [(vec, *x) for x in nearest(query, own, m, keys, ids, k)]
        return pd.DataFrame(out, columns=COLUMNS)

    left, right = (x.select("part", "row", "vec_id", "embedding").groupBy("part") for x in (left, right))
    return left.cogroup(right).applyInPandas(block, FOUND)
