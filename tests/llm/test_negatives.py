"""Operator 13 against plain Python and SQL."""

import math
import random

import duckdb
import numpy as np
import pytest

from retrievo.llm import negatives, queries
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<double>, label int, row int, rank string, score double"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "k", 1.5) for r in rows], SCHEMA)


def brute(rows, every=100):
    whole = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for k, (i, v, label) in enumerate(whole):
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (rows[k][1], label, k)), (whole[k][1], label, k)) if i in anchors else (v, label, k)
    out = []
    for anchor, (v, label, own) in anchors.items():
        score = [(-sum(a * b for a, b in zip(v, w, strict=True)), i, k) for k, (i, w, _) in enumerate(whole)]
        for s, positive, _ in sorted(x for x in score if whole[x[2]][2] == label and x[2] != own)[:5]:
            fits = sorted(x for x in score if whole[x[2]][2] != label and -80 * s <= -100 * x[0] <= -100 * s)[:5]
            out += [(anchor, positive, rank, i, -s, -n) for rank, (n, i, _) in enumerate(fits, 1)]
    return sorted(out)


def made(n, dim, seed, scale=1.0, kinds=4):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim)) * scale
    x[: n // 3] = x[0] + r.normal(size=(n // 3, dim)) * scale / 8  # a third is close together
    return [(i, [float(f) for f in v], int(k)) for i, (v, k) in enumerate(zip(x, r.integers(0, kinds, n), strict=True))]


@pytest.mark.parametrize(("chunk", "lot", "scale"), [(2048, 1024, 0.2), (40, 2, 0.2), (100, 3, 1e5)])
def test_against_plain_python(spark, chunk, lot, scale):
    rows = made(500, 12, 3, scale)
    got = negatives.mine(frame(spark, rows), chunk=chunk, lot=lot).select(*COLUMNS).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)
    assert got


def test_products_beyond_doubles(spark):
    rows = [(i, [float(random.Random(i * 9 + j).randrange(-(2**20), 2**20)) for j in range(6)], i % 2) for i in range(250)]
    got = negatives.mine(frame(spark, rows), chunk=100).select(*COLUMNS).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)
    assert max(r.positive_score for r in got) > 2**53


def test_defined_cases(spark):
    rows = made(220, 5, 8)
    odd = [(None, [1.0] * 5, 1), (300, None, 1), (400, [1.0, None, 1.0, 1.0, 1.0], 1), (500, [1.0, float("nan"), 1.0, 1.0, 1.0], 1), (600, [float("inf")] * 5, 1), (700, [1.0] * 5, None)]
    ties = [(800 + i, [0.5] * 5, i % 3) for i in range(30)]
    got = negatives.mine(frame(spark, [*rows, *odd, *ties, (900, [0.0] * 5, 1), (1000, [1.0] * 4, 1), (1100, [1e300] * 5, 1)])).select(*COLUMNS).collect()
    assert sorted(tuple(r) for r in got) == brute([*rows, *ties, (900, [0.0] * 5, 1)])
    assert negatives.mine(frame(spark, [])).collect() == []
    assert negatives.mine(frame(spark, odd)).collect() == []


def test_repeated_rows_are_candidates(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.9, 0.0], 2), (1, [0.9, 0.0], 2)]
    got = sorted(tuple(r) for r in negatives.mine(frame(spark, rows)).select(*COLUMNS).collect())
    assert got == [(0, 0, 1, 1, 65536, 58880), (0, 0, 2, 1, 65536, 58880)]


def test_planes_drop_candidates():
    rows, anchors = np.floor(np.random.default_rng(1).normal(size=(2000, 64)) * 32), np.floor(np.random.default_rng(2).normal(size=(20, 64)) * 32)
    walk, keep, left = negatives.Sliced(rows).intervals(anchors), None, []
    while True:
        try:
            a, c, lower, upper = walk.send(keep)
        except StopIteration:
            break
        exact = (anchors[a] * rows[c]).sum(axis=1)
        assert (lower <= exact).all() and (exact <= upper).all()
        keep = upper >= negatives.greatest(a, lower, 20, 5)[a]
        left.append(int(keep.sum()))
    assert left == sorted(left, reverse=True) and left[-1] >= 100 and left[-3] < 20 * 2000 / 10


@pytest.mark.parametrize("folder", [SF, SF.replace("0.001", "0.01")])
def test_against_sql(spark, folder):
    got = queries.op13_negatives(spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.execute(negatives.SQL).fetchall())
