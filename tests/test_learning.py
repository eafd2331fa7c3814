"""Boosted trees, scorers, weight search, bounds, segmentation, ContraNorm, k-means starts and stores, against plain forms."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from retrievo.operators import boosting, dense, graph, learning, lexical, metrics, scorers, segmentation
from retrievo.sources import pages
from retrievo.streaming import logs


def grown(x, y, w, params):
    """The same trees by plain loops over numpy columns."""
    edges = [sorted({float(np.sort(c)[max(math.ceil(j / params.bins * len(c)) - 1, 0)]) for j in range(1, params.bins)} - {float(c.max())}) for c in x.T]
    bins = np.array([[sum(e < v for e in es) for v, es in zip(row, edges, strict=True)] for row in x])
    p = (w * y).sum() / w.sum()
    base, trees = math.log(p / (1 - p)), []
    margin = np.full(len(x), base)
    for _ in range(params.trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = w * (q - y), w * q * (1 - q)
        node, splits = np.zeros(len(x), dtype=int), []
        for level in range(params.depth):
            best = (params.least_gain, None)
            for f, es in enumerate(edges):
                for b in range(len(es)):
                    gain = 0.0
                    for n in range(1 << level):
                        here, low = node == n, bins[:, f] <= b
                        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + params.l2)
                        gain += part(here & low) + part(here & ~low) - part(here)
                    if round(gain, 9) > best[0]:
                        best = (round(gain, 9), (f, b))
            if best[1] is None:
                break
            splits.append(best[1])
            node = node | ((bins[:, best[1][0]] > best[1][1]).astype(int) << level)
        leaves = [-params.rate * g[node == n].sum() / (h[node == n].sum() + params.l2) for n in range(1 << len(splits))]
        trees.append((tuple(splits), leaves))
        margin = margin + np.array(leaves)[node]
    return base, trees, 1 / (1 + np.exp(-margin))


def test_trees_against_plain_loops(spark):
    r = np.random.default_rng(2)
    x = np.column_stack((r.normal(size=300), r.normal(size=300), r.integers(0, 4, 300)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 1)).astype(float)
    w = np.where(y == 1, 2.0, 1.0)
    params = boosting.Boosting(trees=3, depth=2, bins=8)
    rows = spark.createDataFrame([(i, [float(v) for v in row], int(a), float(b)) for i, (row, a, b) in enumerate(zip(x, y, w, strict=True))], "id int, features array<double>, label int, weight double")
    model = boosting.fit(rows, weight="weight", params=params)
    base, trees, score = grown(x, y, w, params)
    assert model.base == pytest.approx(base)
    assert [t.splits for t in model.trees] == [s for s, _ in trees]
    assert [v for t in model.trees for v in t.leaves] == pytest.approx([v for _, leaves in trees for v in leaves])
    got = [r.p for r in rows.select("id", model.score(F.col("features")).alias("p")).orderBy("id").collect()]
    assert got == pytest.approx(score.tolist())


def test_trees_of_odd_rows(spark):
    rows = spark.createDataFrame([([1.0, None], 1), ([None, float("nan")], 0), ([3.0, 2.0], 1), ([0.0, 5.0], 0)] * 5, "features array<double>, label int")
    model = boosting.fit(rows, params=boosting.Boosting(trees=5, depth=2, bins=4))
    by = rows.select("label", model.score(F.col("features")).alias("p")).groupBy("label").agg(F.avg("p").alias("p")).collect()
    p = {r.label: r.p for r in by}
    assert p[1] > 0.7 > 0.3 > p[0]
    assert boosting.fit(rows.limit(0)).trees == ()


def test_learned_ranker_beats_cosine_on_held_out_queries(spark):
    r = np.random.default_rng(5)
    kinds = r.normal(size=(8, 6))
    vec = []
    for i in range(320):  # six components tell kinds apart, ten are noise of greater size
        v = np.concatenate((kinds[i % 8] + r.normal(size=6) * 0.5, r.normal(size=10) * 2))
        vec.append((i, [float(x) for x in v / np.linalg.norm(v)], i % 8))
    rows = spark.createDataFrame(vec, "doc_id long, d array<double>, kind int")
    asked = rows.filter("doc_id % 8 = doc_id % 5").select(F.col("doc_id").alias("query_id"), F.col("d").alias("q"), F.col("kind").alias("asked"))
    pairs = asked.crossJoin(rows).filter("query_id <> doc_id")
    cosine = pairs.select("query_id", "doc_id", F.aggregate(F.zip_with("q", "d", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v).alias("cosine"), (F.col("asked") == F.col("kind")).cast("int").alias("label"))
    features = learning.pair_features(cosine, asked.select("query_id", "q"), rows.select("doc_id", "d"), "cosine").persist()
    model = learning.fit_ranker(features.filter("query_id % 2 = 0"), params=boosting.Boosting(trees=12, depth=3))
    held = features.filter("query_id % 2 = 1")
    relevant = held.filter("label = 1").select("query_id", "doc_id", F.lit(1).alias("score"))
    learned = learning.predict_top_k(model, held, 10)
    plain = learning.top_k(held.select("query_id", "doc_id", F.col("cosine").alias("score")), 10)
    precision = lambda run: metrics.per_query(run, relevant).agg(F.avg("precision")).first()[0]
    assert learned.groupBy("query_id").count().filter("count <> 10").isEmpty()
    assert precision(learned) > precision(plain) + 0.1


def test_scorer_against_one_pair_at_a_time(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(r.choices(words, k=n))
    queries = [(i, text(r.choice([1, 3, 8]))) for i in range(6)] + [(6, None), (7, "")]
    docs = [(i, text(r.choice([2, 30, 200, 1500]))) for i in range(25)] + [(25, None), (26, "")]
    model = scorers.OverlapModel()
    q, d = spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string, x int" if False else "doc_id long, text string")
    pairs = q.crossJoin(d).select("query_id", "doc_id")
    for cells in (1, 20_000, 1 << 22):
        got = {(x.query_id, x.doc_id): x.score for x in scorers.score_pairs(pairs.unionAll(pairs), q, d, model, window=64, cells=cells).collect()}
        assert len(got) == len(queries) * len(docs)
        for (i, a), (j, b) in itertools.product(queries, docs):
            asked, ids = model.encode(a), model.encode(b)
            windows = [ids[k : k + 64] for k in range(0, max(len(ids), 1), 64)]
            each = [scorers.yes(model.logits(scorers.padded([asked]), scorers.padded([x])))[0] for x in windows]
            assert got[i, j] == pytest.approx(max(each), abs=1e-12)


def test_parzen_search_reaches_the_grid_in_fewer_trials(spark):
    r = np.random.default_rng(9)
    rows, relevant = [], []
    for q in range(12):
        for d in range(30):
            hit = d < 4
            rows += [("a", q, d, float(np.clip(0.75 * hit + r.normal() * 0.2, 0, 1))), ("b", q, d, float(np.clip(0.6 * hit + r.normal() * 0.3 + 0.1, 0, 1))), ("c", q, d, float(r.random()))]
            relevant += [(q, d)] if hit else []
    scores = spark.createDataFrame(rows, "model string, query_id long, doc_id long, score double")
    judged = spark.createDataFrame(relevant, "query_id long, doc_id long")
    grid = learning.search_weights(scores, judged, ["a", "b", "c"], steps=4, threshold=0.5).first()
    found = learning.parzen_search(scores, judged, ["a", "b", "c"], trials=100).collect()
    assert len(found) == 100 < 5**3
    assert found[0].f2 >= grid.f2
    assert sorted(found, key=lambda x: x.trial) == sorted(learning.parzen_search(scores, judged, ["a", "b", "c"], trials=100).collect(), key=lambda x: x.trial)
    by = {}
    for m, q, d, s in rows:
        by.setdefault((q, d), {})[m] = s
    for x in found[:3]:  # F2 of a trial by hand
        total = sum(x.weights.values())
        predicted = {k for k, s in by.items() if round(sum(s[m] * (w / total) for m, w in sorted(x.weights.items())), 9) >= x.threshold}
        hits = len(predicted & set(relevant))
        assert x.f2 == pytest.approx(5 * hits / (4 * len(relevant) + len(predicted)))


def test_bounded_graph_is_exact_and_reads_less(spark):
    r = random.Random(4)
    texts = []
    for topic in range(12):  # words of a topic, and words of all
        for _ in range(40):
            n = r.choice([6, 15, 40])
            texts.append(" ".join([f"t{topic}x{r.randrange(30)}" for _ in range(n)] + [f"all{int(r.random() ** 3 * 40)}" for _ in range(n)]))
    texts += ["", None, "all1"] + texts[:5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for k, block in ((5, 64), (3, 7)):
        bounded = graph.bounded_graph(docs, k, block=block)
        want = lexical.document_graph(docs, k).collect()
        assert sorted(map(tuple, bounded.edges.collect())) == sorted(map(tuple, want))
        row = bounded.examined.agg(F.sum("matches").alias("m"), F.sum("read").alias("r")).first()
        assert row.r < 0.6 * row.m


def test_bounded_graph_in_lots_writes_no_bounds(spark, monkeypatch):
    r = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(r.choices(words[: 10 + i % 50], k=30))) for i in range(150)], "doc_id long, text string")
    asked = docs.select("doc_id").filter("doc_id % 3 = 0")
    made, rows = graph.written, []
    monkeypatch.setattr(graph, "written", lambda df, name: rows.append(made(df, name)) or rows[-1])
    bounded = graph.bounded_graph(docs, 4, sources=asked, lot=20)
    want = lexical.document_graph(docs, 4, sources=asked).collect()
    assert sorted(map(tuple, bounded.edges.collect())) == sorted(map(tuple, want))
    # terms asked, seeds and the best of each task; no rows by (source, block, term)
    assert sum(t.count() for t in rows) < 50 * (30 + 8) + 50 * 20 * (4 + 1)
    assert bounded.examined.count() == 50


def test_best_path_against_every_cut():
    r = random.Random(6)
    for _ in range(200):
        run = "".join(r.choices("abc", k=r.randrange(0, 9)))
        words = {"".join(r.choices("abc", k=r.randrange(1, 4))): -r.choice([1.0, 2.0, 3.5, 5.0]) for _ in range(12)}
        cuts = []
        for mask in range(1 << max(len(run) - 1, 0)):
            parts, at = [], 0
            for i in range(1, len(run)):
                if mask >> (i - 1) & 1:
                    parts.append(run[at:i])
                    at = i
            parts.append(run[at:])
            parts = [p for p in parts if p]
            if all(p in words or len(p) == 1 for p in parts):
                cuts.append((sum(words.get(p, -9.0) for p in parts), [len(p) for p in parts], parts))
        assert segmentation.best_path(run, words, -9.0, 3) == max(cuts)[2]


def test_segments_of_runs(spark):
    texts = ["今天天气很好", "天气预报说今天下雨", "很好的天气", "今天", "下雨天气很不好"]
    runs = spark.createDataFrame([(t,) for t in texts * 3] + [(None,), ("",), ("x今天",)], "run string")
    lexicon = segmentation.learned(segmentation.run_words(runs.filter("run is not null")), 4, 2)
    got = {r.run: r.words for r in segmentation.segmented(runs, lexicon, 4).collect()}
    scores = {r.word: r.score for r in lexicon.collect()}
    floor = min(scores.values()) - segmentation.UNKNOWN
    assert got == {t: segmentation.best_path(t, scores, floor, 4) for t in {*texts, "", "x今天"}}
    assert "今天" in got["x今天"] and all("".join(w) == t for t, w in got.items())


def test_contranorm_by_hand(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(90, 5))
    x[3] = 0
    keys = ["a"] * 60 + ["b"] * 29 + [None]
    rows = spark.createDataFrame([(k, i, [float(v) for v in row], 1) for i, (k, row) in enumerate(zip(keys, x, strict=True))], "kind string, id long, embedding array<double>, i int")
    for block in (1024, 16):
        got = {q.id: q.embedding for q in dense.contranorm(rows, "kind", "id", tau=0.5, block=block).collect()}
        assert len(got) == 90
        for i, k in enumerate(keys):
            group = np.array([row for row, other in zip(x, keys, strict=True) if other == k])
            unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
            w = np.exp([unit(x[i]) @ unit(y) / 0.5 for y in group])
            z = 1.5 * x[i] - 0.5 * (w / w.sum()) @ group
            assert got[i] == pytest.approx(((z - z.mean()) / np.sqrt(z.var() + 1e-5)).tolist(), abs=1e-9)


def test_ten_starts_are_as_good_as_the_best(spark):
    r = np.random.default_rng(8)
    x = np.concatenate([c + r.normal(size=(30, 3)) for c in r.normal(size=(6, 3)) * 6])
    rows = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    best, inertia = dense.kmeans_starts(rows, 6, starts=6)
    single = [dense.kmeans_starts(rows, 6, starts=1, seed=42 + i)[1][0] for i in range(6)]
    assert [inertia[i] for i in range(6)] == pytest.approx(single)
    assert len({round(v, 6) for v in single}) > 1
    labels = np.array([q.cluster for q in best.orderBy("vec_id").collect()])
    spread = sum(((x[labels == c] - x[labels == c].mean(axis=0)) ** 2).sum() for c in set(labels.tolist()))
    assert spread == pytest.approx(min(single)) and min(inertia.values()) == pytest.approx(min(single))


def actions(n, seed):
    r = random.Random(seed)
    rows = []
    for seq in range(n):
        action = r.choices(["label", "flag", "unflag", "submit", "odd"], [60, 20, 15, 1, 4])[0]
        rows.append((seq, r.choice(["ann", "bob", "cyd", None]), r.choice([1, 2, 3, 4, None]), action, r.choice(["RELEVANT", "NOT_RELEVANT", "MAYBE", None]) if action == "label" else None))
    return rows


def test_label_store_equals_a_fold(spark, tmp_path):
    rows = actions(240, 3)
    state, locked = {}, set()
    for _, who, pair, action, label in rows:
        if who is None or who in locked or (pair is None and action != "submit"):
            continue
        if action == "submit":
            locked.add(who)
        elif action == "label" and label in logs.LABELS:
            state.setdefault((who, pair), [None, False])[0] = label
        elif action in ("flag", "unflag"):
            state.setdefault((who, pair), [None, False])[1] = action == "flag"
    want = sorted((w, p, str(v[0]), v[1]) for (w, p), v in state.items() if v[0] or v[1])
    schema = "seq long, annotator string, pair_id long, action string, label string"
    table = spark.createDataFrame(rows, schema)
    told = lambda df: sorted((r.annotator, r.pair_id, str(r.label), r.flagged) for r in df.collect())
    assert told(logs.folded(table)) == want and locked and len(locked) < 3
    for i in range(4):
        table.filter(f"seq between {60 * i} and {60 * i + 59}").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        logs.label_store(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert told(logs.labels_of(spark, str(tmp_path / "out"), 3)) == want


def test_stream_broken_off_and_started_again(spark, tmp_path):
    from pyspark.errors import StreamingQueryException

    rows = spark.createDataFrame([(i % 50, i) for i in range(200)], "key long, x long")
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("key long, x long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    with pytest.raises(StreamingQueryException):
        logs.resumed(stream(), "key", out, state, every=2, fail_at=3).awaitTermination()
    logs.resumed(stream(), "key", out, state, every=2).awaitTermination()
    logs.resumed(stream(), "key", out, state, every=2).awaitTermination()
    assert sorted(r.key for r in spark.read.parquet(out).collect()) == list(range(50))
    exports = sorted(p.name for p in (tmp_path / "out-export").iterdir())
    assert exports == ["upto=1", "upto=3"]


def test_listed_items(spark):
    html = '<nav><ul><li><a href="/a">A &amp; b</a> more</li><li>plain<li><a>no target</a><a href="/x">second</a></ul></nav><li>outside</li><nav><li></li><nav><li>deep</li></nav><li><a href="/l">last'
    rows = spark.createDataFrame([(1, html, "t"), (2, None, "t"), (3, "", "t")], "page_id long, html string, title string")
    got = [tuple(r) for r in pages.listed(rows, "nav", "li", no_title="?").orderBy("page_id", "place").collect()]
    assert got == [(1, 0, "A & b", "/a"), (1, 1, "plain", "#"), (1, 2, "no target", "#"), (1, 3, "?", "#"), (1, 4, "deep", "#"), (1, 5, "last", "/l")]
