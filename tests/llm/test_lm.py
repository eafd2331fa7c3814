"""Operator 5: the base score against plain Python, and the model's probabilities."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from retrievo.llm import lm
from retrievo.llm.words import word_hashes
from tests.conftest import SF
from tests.llm.cases import frame


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def test_word_hashes():
    for text in ("", " ", "a", "A b\ta  B\n", "é É ü中 文", "x" * 3_000_000 + " y  X", "ab " * 900_000):
        want, hashes = words(text), word_hashes(text.encode())
        assert len(hashes) == len(want)
        assert len(set(hashes.tolist())) == len(set(want))
        assert len(set(zip(hashes.tolist(), want, strict=True))) == len(set(want))


@pytest.mark.parametrize("table", ["cases", "documents"])
def test_base_scores(spark, table):
    df = frame(spark) if table == "cases" else spark.read.parquet(f"{SF}/documents.parquet")
    rows = lm.score(df, steps=20).collect()
    docs = [(r["doc_id"], words(r["text"]) + [None]) for r in df.collect()]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, ws in docs if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), out(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 5)) for i, ws in docs)
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in rows)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert all(abs(a[5] - b[5]) < 1e-4 for a, b in zip(got, want, strict=True))
    assert all(r["score"] < 0 for r in rows)


def small_model(rng):
    counts = np.zeros(lm.VOCABULARY + 1, dtype=np.int64)
    counts[:300] = rng.integers(1, 50, 300)
    got = rng.integers(0, 300, (200, lm.WIDTH + 1))
    cls = lm.cluster(got, counts, rng)
    symbol = np.append(lm.OWN + cls, lm.OWN + lm.CLASSES)
    plus = counts + 1.0
    share = np.log10(plus / np.bincount(cls, weights=plus, minlength=lm.CLASSES)[cls])
    w = lm.train(got, symbol[got[:, :-1]], cls[got[:, 1:]], 30, rng)
    return lm.Model(symbol, cls, share, w)


def test_each_id_is_scored_once_in_its_window():
    rng = np.random.default_rng(0)
    model = small_model(rng)
    texts = [rng.integers(0, 400, n) for n in (0, 1, 31, 32, 33, 55, 56, 57, 200)]
    got = lm.text_scores(model, np.concatenate(texts), np.array([len(t) for t in texts]), batch=3)
    for text, score in zip(texts, got, strict=True):
        ids, want = [lm.END + 1, *text, lm.END], 0.0
        for i in range(1, len(ids)):
            window = 0 if i <= lm.WIDTH else -(-(i - lm.WIDTH) // lm.STRIDE)
            context = model.symbol[ids[window * lm.STRIDE : i]]
            z = lm._forward(model.w, np.array([context]))["z"][-1].astype(float)
            p = np.exp(z - z.max())
            want += math.log10(p[model.cls[ids[i]]] / p.sum()) + model.share[ids[i]]
        assert abs(want - score) < 1e-3 * max(1, len(text) / 10)


def test_probabilities_sum_to_one():
    model = small_model(np.random.default_rng(1))
    z = lm._forward(model.w, np.array([model.symbol[[lm.END + 1, 5, 7]]]))["z"][-1].astype(float)
    p = np.exp(z - z.max())
    p /= p.sum()
    assert abs(sum(p[c] * (10 ** model.share[model.cls == c]).sum() for c in range(lm.CLASSES) if (model.cls == c).any()) - sum(p[c] for c in range(lm.CLASSES) if (model.cls == c).any())) < 1e-9


def test_gradients_against_finite_differences():
    rng = np.random.default_rng(2)
    inputs, want = rng.integers(0, 50, (3, 7)), rng.integers(-1, lm.CLASSES, (3, 7))
    w = {k: v.astype(np.float64) for k, v in lm.train(inputs, inputs, want, 0, rng).items()}

    def loss():
        z = lm._forward(w, inputs)["z"]
        logs = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        y = want.ravel()
        return -logs[np.arange(len(y)), np.maximum(y, 0)][y >= 0].mean()

    for key, grad in lm.gradients(w, inputs, want).items():
        spots = np.argsort(-np.abs(grad).ravel())[:6]
        for spot in spots:
            flat = w[key].reshape(-1)
            old = flat[spot]
            flat[spot] = old + 1e-5
            up = loss()
            flat[spot] = old - 1e-5
            down = loss()
            flat[spot] = old
            assert abs((up - down) / 2e-5 - grad.ravel()[spot]) < 1e-5, key


def test_the_model_beats_unigrams_of_its_ids(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lm.score(df).collect()
    held = [r for r in rows if r["held_out"]]
    folder_ids = [r["score"] for r in held]
    assert len(held) > 50 and all(math.isfinite(s) for s in folder_ids)
    ids = {r["doc_id"]: r["text"] for r in df.collect()}
    encode = lm.packing.encoder(lm.packing.default_ranks())
    counts = np.ones(lm.VOCABULARY + 1)
    for r in rows:
        if not r["held_out"]:
            np.add.at(counts, np.frombuffer(encode(ids[r["doc_id"]] or ""), dtype="<u4"), 1)
            counts[lm.END] += 1
    logs = np.log10(counts / counts.sum())
    unigram = sum(logs[np.frombuffer(encode(ids[r["doc_id"]] or ""), dtype="<u4")].sum() + logs[lm.END] for r in held)
    assert sum(folder_ids) > unigram + 0.02 * abs(unigram)


def test_empty(spark):
    assert lm.score(frame(spark, []), steps=5).count() == 0


def test_windows_want_every_id_and_end_once():
    rng = np.random.default_rng(4)
    model = small_model(rng)
    model.cls = np.arange(lm.VOCABULARY + 1)  # tells ids apart
    texts = [rng.integers(0, 400, n) for n in (0, 1, 31, 32, 33, 5_000)]
    symbols, target = lm.all_windows(model, np.concatenate(texts), np.array([len(t) for t in texts]))
    assert target[target >= 0].tolist() == [i for t in texts for i in [*t, lm.END]]
    assert symbols[0, 0] == model.symbol[lm.END + 1] and symbols.shape == (1 + 1 + 1 + 2 + 2 + 157, lm.WIDTH)


def test_the_model_learns_from_all_rows_without_a_sample(spark):
    numbers = [str(i) for i in range(100, 240)]
    texts = [" ".join((numbers * 4)[i % 140 : i % 140 + 400]) for i in range(1_500)]
    rows = [r for r in lm.score(frame(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)]), sample_docs=0).collect() if r["held_out"]]
    encode = lm.packing.encoder(lm.packing.default_ranks())
    ids = [np.append(np.frombuffer(encode(t), dtype="<u4"), lm.END) for t in texts]
    counts = np.bincount(np.concatenate([x for i, x in enumerate(ids) if not lm.held_out(i)]), minlength=lm.VOCABULARY + 1) + 1.0
    logs = np.log10(counts / counts.sum())
    # a short pass from random weights: 1.12 times the unigram's logarithms, untrained weights 1.87 times
    assert len(rows) > 100 and sum(r["score"] for r in rows) > 1.3 * sum(logs[ids[r["doc_id"]]].sum() for r in rows)


def test_contexts_of_all_training_rows_are_counted(spark):
    df = frame(spark)
    folder = lm.fresh(spark, "lm-test")
    listed = lm.blocks(df, folder)
    counts = lm.id_counts(listed, folder)
    known = lm.known_ids(counts)
    assert lm.all_contexts(listed, folder, known).sum(axis=1).tolist() == counts[known].tolist()


def test_distinct_parts_give_the_ids_and_words_of_whole_texts():
    path = lm.packing.default_ranks()
    encode, sizes = lm.packing.encoder(path), lm.packing.id_sizes(path)
    marks = ["a", "B", "é", "中", " ", "  ", "\n", "\t", "'s", "'ll", "1", "23", ".", "--", "　", "\x85", "\xa0", "\x1c", "\0", " a", " the", " word", "😀", "́", "\r\n", " '", "<|endoftext|>"]
    rng = np.random.default_rng(5)
    cases = [["".join(rng.choice(marks, rng.integers(0, 30))) for _ in range(rng.integers(1, 40))] for _ in range(100)]
    for texts in [*cases, [""], ["\n\na", "a ", " a", "it's,it's"], ["x" * 700_000 + " y", "", "ab " * 300_000]]:
        seen = []
        ids, lengths, words, counts = lm.contents(lambda t: seen.append(len(t)) or encode(t), sizes, [t.encode() for t in texts])
        want = [np.frombuffer(encode(t), dtype="<u4") for t in texts]
        assert ids.tolist() == np.concatenate(want).tolist() and lengths.tolist() == [len(i) for i in want]
        hashes = [word_hashes(t.encode()).view(np.int64) for t in texts]
        assert words.tolist() == np.concatenate(hashes).tolist() and counts.tolist() == [len(h) for h in hashes]
    assert sum(seen) < 1_000_000  # a word that comes back is tokenized once


def test_words_are_counted_in_lots(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    folder = lm.fresh(spark, "lm-test")
    listed = lm.blocks(df, folder)
    want, got = Counter(), {}
    for name in (r["block"] for r in listed.collect()):
        b = lm._read(folder, name, {"keys", "train"})
        for key, n in zip(b["keys"].tolist(), b["train"].tolist(), strict=True):
            want[key] += n
    for lot_words in (1 << 30, 200):
        rows = sorted(lm.word_counts(listed, folder, lot_words).collect(), key=lambda r: (r["block"], r["lot"]))
        for name in {r["block"] for r in rows}:
            keys = lm._read(folder, name, {"keys"})["keys"].tolist()
            c = np.frombuffer(b"".join(r["c"] for r in rows if r["block"] == name), dtype=np.int64)
            got |= dict(zip(keys, c.tolist(), strict=True))
        assert got == dict(want) and len({r["lot"] for r in rows}) == max(1, -(-sum(r["words"] for r in listed.collect()) // lot_words))
        assert sum(r["types"] for r in rows) == sum(n > 0 for n in want.values())


def test_steps_in_the_same_room_give_the_same_gradients():
    rng = np.random.default_rng(6)
    model, room = small_model(rng), lm.Room(np.float32)
    for n in (5, 64, 3, 64):
        inputs, want = rng.integers(0, 50, (n, lm.WIDTH)), rng.integers(-1, lm.CLASSES, (n, lm.WIDTH))
        got, fresh = lm.gradients(model.w, inputs, want, room), lm.gradients(model.w, inputs, want)
        assert all((got[k] == fresh[k]).all() for k in fresh)
