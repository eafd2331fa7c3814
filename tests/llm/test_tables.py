"""Operators 1, 3 and 7 and the pipeline against plain Python."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from retrievo.llm import jaccard, mixing, secret_scan, sharding, toxicity
from tests.conftest import SF
from tests.llm.cases import ROWS, frame

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]


def documents(spark, table):
    return frame(spark) if table == "cases" else spark.read.parquet(f"{SF}/documents.parquet")


def filled(sizes):
    """Targets by rounds of resharing."""
    keys = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(keys)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in keys if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3 * sizes[s] for s in over}


@pytest.mark.parametrize("table", ["cases", "documents"])
def test_mix(spark, table):
    df = documents(spark, table)
    rows = mixing.mix(df).collect()
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in rows) == Counter((r["doc_id"], len(words(r["text"])), r["source"]) for r in df.collect())
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert (r["position"] is None) == (r["taken"] == 0) and (r["position"] is None or 0 <= r["position"] <= 1)
    target = filled(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert sorted(map(str, mixing.mix(df.repartition(3)).collect())) == sorted(map(str, rows))
    assert mixing.mix(frame(spark, [])).count() == 0


def test_schedules_move_sources(spark):
    rows = [(i, "w " * 10, "en", "abc"[i % 3], 20) for i in range(300)]
    got = mixing.mix(frame(spark, rows), weights=(1, 1, 1)).collect()
    mean = {s: sum(r["position"] for r in got if r["source"] == s) / 100 for s in "abc"}
    assert mean["a"] < 0.45 < mean["b"] < 0.55 < mean["c"]


def test_apply_mix(spark):
    """Every row's copies hold the words that the plan takes of it; rows that repeat an id are told apart."""
    twins = [(1, "w " * 6, "en", "s1", 1), (1, "w " * 6, "en", "s2", 1), (1, "v " * 6, "en", "s1", 1), (None, "u " * 5, "en", "s1", 1), (None, "t " * 9, "en", "s2", 1)]
    for df in (frame(spark), frame(spark, twins), frame(spark, ROWS + twins * 2)):
        plan = Counter()
        for r in mixing.mix(df).collect():
            plan[r["doc_id"], r["source"], r["size"]] += r["taken"]
        out = mixing.apply_mix(df)
        assert out.columns == df.columns
        texts = defaultdict(list)
        for r in df.collect():
            texts[r["doc_id"], r["source"]].append(words(r["text"]))
        got = Counter()
        for r in out.collect():
            n = len(words(r["text"]))
            whole = [len(t) for t in texts[r["doc_id"], r["source"]] if t[:n] == words(r["text"])]
            got[r["doc_id"], r["source"], min(whole)] += n
        assert {k: v for k, v in plan.items() if v} == dict(got)


@pytest.mark.parametrize("table", ["cases", "documents"])
def test_shards(spark, table):
    df = documents(spark, table)
    rows = sharding.shard(df).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((r["doc_id"], size(r["text"]), zlib.crc32((r["text"] or "").encode())) for r in df.collect())
    slots, load = defaultdict(list), Counter()
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 16
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    share, most = sum(load.values()) / 16, max(r["size"] for r in rows)
    assert all(abs(load[s] - share) <= most + share / 32 + 1 for s in range(16))
    assert sorted(map(str, sharding.shard(df.repartition(3)).collect())) == sorted(map(str, rows))
    assert sharding.shard(frame(spark, [])).count() == 0


def test_hot_text_is_split_and_small_groups_stay_together(spark):
    rows = [(i, "the same text " * 5, "en", "a", 1) for i in range(1000)] + [(5000 + i, f"text number {i % 1000} " * 4, "en", "a", 1) for i in range(2000)]
    got = sharding.shard(frame(spark, rows)).collect()
    load, homes = Counter(), defaultdict(set)
    for r in got:
        load[r["shard"]] += r["size"]
        homes[r["text_crc32"]].add(r["shard"])
    assert max(load.values()) - min(load.values()) <= 400
    hot = zlib.crc32(("the same text " * 5).encode())
    assert len(homes[hot]) >= 4 and all(len(v) == 1 for k, v in homes.items() if k != hot)


def linked(docs, n, percent):
    """doc_id -> (set size, least linked id), by comparing all pairs."""
    sets = {}
    for i, text in docs:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
        sets[i] = frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        shared = Counter(j for g in s for j in holders[g])
        for g in s:
            holders[g].append(i)
        for j, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def variants(rng, groups, size):
    """Groups of texts at all distances around the threshold."""
    docs = []
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 30, 80, 200]))]
        for _ in range(rng.randrange(1, size)):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(text) // 8)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(50)}"
            docs.append((len(docs), " ".join(text)))
    return docs


@pytest.mark.parametrize("n, percent, hot", [(4, 85, 16), (5, 80, 16), (2, 60, 1), (3, 90, 2)])
def test_join_is_exact(spark, n, percent, hot):
    import random

    docs = variants(random.Random(percent), 120, 9)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(docs, "doc_id long, text string"), n=n, percent=percent, hot=hot).collect()}
    assert got == linked(docs, n, percent)


def test_hot_passages_and_large_groups(spark):
    import random

    rng = random.Random(1)
    passage = [f"p{i}" for i in range(40)]
    docs = [(i, " ".join([f"a{rng.randrange(10**6)}" for _ in range(40)] + passage)) for i in range(150)]
    base = [f"b{i}" for i in range(120)]
    for i in range(150):
        text = list(base)
        text[rng.randrange(120)] = f"v{i}"
        docs.append((1000 + i, " ".join(text)))
    docs += [(2000 + i, "one and the same text for all of them") for i in range(200)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(docs, "doc_id long, text string"), hot=8).collect()}
    assert got == linked(docs, 4, 85)


def test_join_cases(spark):
    rows = jaccard.join(frame(spark)).collect()
    assert len(rows) == len(ROWS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert got[1] == got[2] == (4, 1) and got[3] == (0, 3) and got[4] == (0, 4) and got[5] == (0, 5) and got[0] == (0, 0)
    assert got[9] == (1, 9) and got[10] == (1, 10) and got[None] == (1, None)
    assert jaccard.join(frame(spark, [])).count() == 0
    kept = jaccard.keep_one(frame(spark))
    assert kept.columns == frame(spark).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i in (0, 1, 3, 4, 5, 6, 7, 8, 9, 10, None))


def test_rows_without_id_and_rows_that_share_an_id(spark):
    """A text known only by rows without id links others; of texts that share an id each has its own set."""
    base = [f"w{i}" for i in range(100)]
    near = lambda *at: " ".join(f"x{i}" if i in at else w for i, w in enumerate(base))
    rows = [(1, near(3)), (None, near()), (2, near(96)), (7, "alpha " + near(50, 51, 52, 53, 20, 70)), (7, " ".join(f"u{i}" for i in range(60))), (None, "some text of its own here"), (None, "some text of its own here")]
    found = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), percent=88).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in found) == sorted([("1", "1"), ("None", "1"), ("2", "1"), ("7", "7"), ("7", "7"), ("None", "None"), ("None", "None")])
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), n=4, percent=88).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted((str(i), t) for i, t in (rows[0], rows[3], rows[4], rows[5]))
    repeated = jaccard.keep_one(spark.createDataFrame([(1, "same text twice in here now")] * 3 + [(1, "and another one under the same id")], "doc_id long, text string"))
    assert repeated.count() == 2


@pytest.mark.parametrize("rows_of_a_block", [16, 1024])
def test_large_group_of_near_copies(spark, monkeypatch, rows_of_a_block):
    """Copies of one text with few to many words changed: some link, most lie about the threshold."""
    import random

    monkeypatch.setattr(jaccard, "BLOCK_ROWS", rows_of_a_block)
    rng, base, docs = random.Random(7), [f"b{i}" for i in range(90)], []
    for i in range(600):
        share = rng.choice([0.01, 0.02, 0.03, 0.05, 0.08])
        docs.append((i, " ".join(f"v{rng.randrange(10**6)}" if rng.random() < share else w for w in base)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == linked(docs, 4, 85)


@pytest.mark.parametrize("batch", [1, 7, 50, 10_000])
def test_rows_of_a_bucket_meet(batch):
    """All pairs that may link, in any cut of the rows into batches, and each class's nearest, against plain loops."""
    import numpy as np
    import pandas as pd

    rng, rows = np.random.default_rng(batch), []
    bands = jaccard.Bands(80)
    sets = {c: np.unique(np.where(rng.random(60) < 0.1, rng.integers(100, 10**6, 60), np.arange(60)).astype(np.uint64)) for c in range(160)}
    for sig, size in enumerate((2, 3, 9, 60, 1, 130, 5)):
        parts = 1 if size < 100 else 3
        for c in rng.choice(160, size, replace=False):
            comp, kind, use, near, home = int(c) // 2 if c % 5 else -1, int(rng.random() < 0.2), rng.random() < 0.5, rng.random() < 0.5, int(c) % parts
            for part in range(parts) if comp != -1 else [home]:
                sketch = jaccard.parities(sets[c], bands.bits(bands.band(len(sets[c]))))
                rows.append((sig, part, part != home, int(c), comp, kind, use, near, len(sets[c]), sketch))
    rows.sort(key=lambda r: r[:3])
    pdf = pd.DataFrame(rows, columns=["sig", "part", "guest", "cls", "comp", "kind", "use", "near", "n_shingles", "sketch"])
    want = set()
    for x in rows:
        for y in rows:
            if x[0] == y[0] and x[3] < y[3] and x[4] != y[4] and not (x[5] and y[5]):
                relied = (x[6] or y[6]) if x[5] == y[5] else (y[6] or x[7]) if y[5] else (x[6] or y[7])
                both = x[8] + y[8]
                may = 100 * min(x[8], y[8]) >= 80 * max(x[8], y[8]) and jaccard.least_difference(x[9], y[9]) <= both - 2 * -(-80 * both // 180)
                if relied and may:
                    want.add((x[3], y[3]))
    got = set()
    for first, i, second, j, _ in jaccard._met((pdf.iloc[k : k + batch] for k in range(0, len(pdf), batch)), 80):
        got |= {(min(p), max(p)) for p in zip(first.cls[i].tolist(), second.cls[j].tolist(), strict=True)}
    assert got == want and len(want) > 100


def test_forest():
    import numpy as np

    rng = np.random.default_rng(2)
    for edges in (0, 1, 40, 400):
        x, y, weight = rng.integers(0, 60, edges), rng.integers(0, 60, edges), rng.integers(0, 9, edges)
        keep = x != y
        x, y, weight = x[keep], y[keep], weight[keep]
        root = list(range(60))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        total = 0
        for w, i, j in sorted(zip(weight.tolist(), x.tolist(), y.tolist(), strict=True)):
            if find(i) != find(j):
                root[find(i)] = find(j)
                total += w
        trees, got = [find(i) for i in range(60)], jaccard.forest(x, y, weight)
        assert weight[got].sum() == total and len(got) == len(set(range(60))) - len(set(trees))


def test_sketches_never_exceed_the_difference():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(200):
        a = np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.9], rng.integers(0, 300, rng.integers(1, 40)).astype(np.uint64))))
        assert jaccard.least_difference(jaccard.fine_parities(a), jaccard.fine_parities(b)) <= len(np.setxor1d(a, b))


def test_components(spark):
    import random

    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for e in links for x in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in jaccard.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}


@pytest.mark.parametrize("table", ["cases", "documents", "empty"])
def test_pipeline(spark, tmp_path, table):
    if table == "documents":
        folder = SF
    else:
        folder = str(tmp_path)
        rows = [(*r[:4], r[4]) for r in ROWS] if table == "cases" else []
        frame(spark, rows).select(*COLUMNS).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (7, 1, 0)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert i == 4 or out.columns == COLUMNS, name
        out.write.parquet(f"{tmp_path}/stage{i}")
        docs = spark.read.parquet(f"{tmp_path}/stage{i}")
        kept.append(docs.collect())
    first = spark.read.parquet(f"{folder}/documents.parquet").collect()
    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    assert Counter(map(str, kept[0])) == Counter(str(r) for r in first if scorer.score(r["text"]) < 0.5)
    groups = linked([(r["doc_id"], r["text"]) for r in kept[0] if r["doc_id"] is not None], 5, 80)
    assert {r["doc_id"] for r in kept[1]} - {None} == {i for i, (_, c) in groups.items() if i == c}
    assert len(kept[1]) == len({r["doc_id"] for r in kept[1]})
    assert Counter(r["doc_id"] for r in kept[2]) == Counter(r["doc_id"] for r in kept[1])
    assert not any(secret_scan.findings(r["text"] or "") for r in kept[2])
    sizes = defaultdict(int)
    for r in kept[2]:
        sizes[r["source"]] += len(words(r["text"]))
    target, taken = filled(sizes) if sizes else {}, defaultdict(int)
    for r in kept[3]:
        taken[r["source"]] += len(words(r["text"]))
    assert all(abs(target[s] - taken[s]) <= 1 for s in target)
    tokens = Counter()
    for r in kept[4]:
        assert 0 <= r["offset"] and r["offset"] + r["length"] <= 1024
        tokens[r["sequence_id"]] += r["length"]
    assert all(n <= 1024 for n in tokens.values())
    assert Counter(r["doc_id"] for r in kept[4] if r["start"] == 0) == Counter(r["doc_id"] for r in kept[3])


def plain_shards(rows, shards):
    """(doc_id, size, crc, shard, slot) by sorting all records by the hash of their text, where no text is a hot key."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    records = []
    for r in rows:
        data = (r["text"] or "").encode()
        key = 42 if r["text"] is None else signed(xxhash.xxh64_intdigest(data, seed=42))
        records.append((key, r["doc_id"], zlib.crc32(data), len(data) + 1))
    records.sort(key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2], x[3]))
    total, group, starts, at = sum(x[3] for x in records), defaultdict(int), [], 0
    for x in records:
        starts.append(at)
        at += x[3]
        group[x[0]] += x[3]
    first, out, rows_of = {}, [], {}
    for i, (x, start) in enumerate(zip(records, starts, strict=True)):
        begin = first.setdefault(x[0], start)
        together = group[x[0]] <= total / shards / 64
        middle = begin + group[x[0]] / 2 if together else start + x[3] / 2
        shard = min(shards - 1, int(middle * shards / total))
        out.append((x[1], x[3], x[2], shard, i - rows_of.setdefault(shard, i)))
    return out


@pytest.mark.parametrize(("ranges", "samples"), [(2, 8192), (3, 20)])
def test_shards_against_a_plain_sort(spark, ranges, samples):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.limit(20)).unionByName(docs.limit(3).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    want = plain_shards(docs.collect(), 16)
    got = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard(docs, ranges=ranges, samples=samples).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert len({x[3] for x in got}) == 16
