"""Operator 12 against a plain form of the method, every pair of sets, and SQL."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from retrievo.llm import queries, superminhash
from retrievo.llm.words import U, gram_sets, mixed
from tests.conftest import SF
from tests.llm import cases


def one_by_one(elements, slots):
    """SuperMinHash of a set, an element after the other, without early stopping."""
    least = [(1 << 64) - 1] * slots
    for e in elements:
        order = list(range(slots))
        for j in range(slots):
            u = int(mixed(np.array([int(e) + (j + 1) * int(superminhash.STEP) & (1 << 64) - 1], dtype=U))[0])
            place = j + ((u & 0xFFFFFFFF) * (slots - j) >> 32)
            order[j], order[place] = order[place], order[j]
            least[order[j]] = min(least[order[j]], (j << 32) | (u >> 32))
    return least


@pytest.mark.parametrize("slots", [1, 7, 100])
def test_signatures_against_one_by_one(slots, monkeypatch):
    r = np.random.default_rng(4)
    found = [r.integers(0, 2**63, n).astype(U) for n in (0, 1, 2, 3, 5, 40, 130, 300, 0, 17)]
    want = [one_by_one(x, slots) for x in found]
    assert superminhash.signatures(found, slots).tolist() == want
    monkeypatch.setattr(superminhash, "TOGETHER", 64)  # sets in parts
    assert superminhash.signatures(found, slots).tolist() == want


def test_slots_agree_as_often_as_sets_are_similar():
    r = np.random.default_rng(7)
    for size in (20, 400):
        shares = []
        for _ in range(150):
            x = r.integers(0, 2**63, size).astype(U)
            a, b = x[: size * 9 // 10], x[size // 10 :]  # 8 of 10 in common
            s = superminhash.signatures([a, b], 100)
            shares.append((s[0] == s[1]).mean())
        assert abs(np.mean(shares) - 0.8) < 0.012
        assert np.std(shares) < 0.04 * 1.15  # independent minima: 0.04


def groups(texts, n, percent):
    """The least position reachable by links, and set sizes, by every pair."""
    sets = [set(g.tolist()) for g in gram_sets(texts, n)]
    to = list(range(len(texts)))

    def find(i):
        while to[i] != i:
            i = to[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if both and 100 * both >= percent * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                to[y] = x
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def corpus(seed, families=12, copies=25):
    """Families of copies with more and less of their words changed; some links are close to the threshold."""
    r = random.Random(seed)
    texts = ["", None, " \t", "one", "One", "two words", "two  WORDS", "two words more"]
    for _ in range(families):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([8, 40, 150, 400]))]
        for _ in range(copies):
            words = list(base)
            for _ in range(r.randrange(1 + len(words) // 6)):
                words[r.randrange(len(words))] = f"w{r.randrange(3000)}"
            texts.append(" ".join(words))
        texts += [texts[-1]] * 3
    r.shuffle(texts)
    return texts


def frame(spark, rows):
    return cases.frame(spark, [(i, t, "en", "a", 1) for i, t in rows])


@pytest.mark.parametrize(("seed", "n"), [(1, 2), (2, 5), (3, 2)])
def test_against_every_pair(spark, seed, n):
    texts = corpus(seed)
    least, sizes = groups(texts, n, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in superminhash.near_duplicates(frame(spark, list(enumerate(texts))), n=n).collect()}
    assert got == {i: (sizes[i], least[i], least[i] == i) for i in range(len(texts))}


def test_large_group_beside_rows_that_do_not_link(spark):
    r = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    near = []
    for _ in range(1300):  # one bucket of near copies larger than a block
        words = list(base)
        words[r.randrange(120)] = f"v{r.randrange(10**6)}"
        near.append(" ".join(words))
    # share three quarters of the words: they meet, but most don't link
    far = [" ".join(base[:90] + [f"u{r.randrange(10**6)}" for _ in range(30)]) for _ in range(60)]
    texts = near + far
    got = {x.doc_id: x.component_id for x in superminhash.near_duplicates(frame(spark, list(enumerate(texts))), n=2).collect()}
    assert all(got[i] == 0 for i in range(1300))
    assert all(got[i] == i for i in range(1300, 1360))


@pytest.mark.parametrize("long", [8192, 100])
def test_pairs_close_to_the_threshold(spark, monkeypatch, long):
    monkeypatch.setattr(superminhash, "LONG", long)
    monkeypatch.setattr(superminhash, "BLOCK_ROWS", 40)
    r = random.Random(5)
    base = [f"w{i}" for i in range(160)]
    texts = []
    for i in range(400):  # similarities on both sides of the threshold, half of the sets longer
        words = list(base[: 80 + 80 * (i % 2)])
        for _ in range(r.randrange(2, 9) * (1 + i % 2)):
            words[r.randrange(len(words))] = f"v{r.randrange(10**6)}"
        texts.append(" ".join(words))
    least, _ = groups(texts, 2, 80)
    got = {x.doc_id: x.component_id for x in superminhash.near_duplicates(frame(spark, list(enumerate(texts))), n=2).collect()}
    assert got == dict(enumerate(least))
    assert 3 < len(set(least)) < 390


def test_shared_elements_by_slices(monkeypatch):
    monkeypatch.setattr(superminhash, "SLICE", 64)
    r = np.random.default_rng(3)
    found = [np.unique(r.integers(0, 500, k).astype(U)) for k in (0, 5, 90, 200, 400)]
    frame = lambda some: superminhash.Part(pd.DataFrame({"cls": range(len(some)), "comp": range(len(some)), "n_shingles": [len(x) for x in some], "grams": [x.tobytes() for x in some]}))
    x, y = frame(found), frame(found[::-1])
    i, j = (k.ravel() for k in np.meshgrid(range(5), range(5)))
    assert superminhash.shared_elements(x, i, y, j).tolist() == [len(set(found[a]) & set(found[4 - b])) for a, b in zip(i, j, strict=True)]
    i, j = i[i != j], j[i != j]
    assert superminhash.shared_elements(x, i, x, j).tolist() == [len(set(found[a]) & set(found[b])) for a, b in zip(i, j, strict=True)]


def test_defined_cases(spark):
    got = superminhash.near_duplicates(cases.frame(spark), n=2).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert len(got) == len(cases.ROWS)
    assert by[1] == [(6, 1, True)] and by[2] == [(6, 1, False)] * 2
    assert by[3] == by[4][:0] + [(0, 3, True)] and by[4] == [(0, 4, True)] and by[5] == [(0, 5, True)] and by[0] == [(0, 0, True)]
    assert by[9] == [(1, 9, True)] and by[10] == [(1, 10, True)]
    assert by[None] == [(2, None, True)]
    assert superminhash.near_duplicates(cases.frame(spark, [])).collect() == []


def test_rows_without_id_link_others(spark):
    words = [f"w{i}" for i in range(40)]
    chain = [(None, " ".join(words)), (7, " ".join(words[2:])), (4, " ".join([*words, "x", "y"]))]
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in superminhash.near_duplicates(frame(spark, chain), n=2).collect())
    assert got == [(0, 4, False), (4, 4, True), (7, 4, False)]


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.op12_near_duplicates(spark, SF)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.execute(superminhash.SQL).fetchall())
