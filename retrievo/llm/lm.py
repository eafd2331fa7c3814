"""Operator 5: language-model scores: a causal self-attention model over subword ids, in numpy.

The text's probability is a product over its subword ids and an end id.  An id's probability is that
of its class, given by attention over the ids before it, times its share of the class:

- classes are clusters of what stands before the ids in all training rows;
- the model (one head, one layer, a residual and a small feed-forward part) is trained by Adam.
  Windows of a bounded sample (``sample_docs``, ``windows``, ``steps``) only give the weights to start
  from.  From there every block is trained on by itself, on all its training ids, each predicted
  once; the result is the mean of the blocks' weights by their windows.  Steps grow with the input;
- shares are counts of ids over all training rows, plus one.

Scoring cuts each text into windows of ``WIDTH`` ids that overlap; every window is scored by batched
masked attention, and each id once, in the first window that holds it, so it has ``WIDTH - STRIDE``
ids of context at least (or the text's start).

The base score is an add-one unigram model of words over all training rows.  Texts are written to
blocks of about ``BLOCK_BYTES`` in the shared folder, with their ids and their words as numbers in a
dictionary of the block.  Texts are cut where neither words nor pieces of the tokenizer go across, and
each distinct part of a block is tokenized and hashed once.  Only dictionaries are shuffled, as arrays:
to ranges of hashes, where counts are summed, and back to their blocks.  So a word travels once a
block, however often it occurs, and the scores need no further pass over the texts.  Blocks have names of their own and only those of successful
tasks are listed, so tasks can be run again.

Words are told apart by 64-bit hashes.  Defined cases: null text is empty text, which has the end
only; rows without an id are training rows; without training rows all counts are 0; repeated rows
give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import io
import math
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrievo.llm import packing
from retrievo.llm.storage import fresh, materialize
from retrievo.llm.words import distinct_parts, part_places, spread, word_places

BLOCK_BYTES = 8 << 20
WIDTH, STRIDE = 32, 24
CLASSES, OWN, DIM, HIDDEN = 64, 2048, 16, 32
LOT_WORDS = 1 << 21
BATCH, PASS_RATE = 64, 0.003
VOCABULARY = 50_257
END = VOCABULARY  # the id after a text
MASK = np.tri(WIDTH, dtype=np.float32)  # what each position of a window sees
END_WORD = np.int64(-1)  # stands for the end among the words' hashes


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


# ---- blocks ----


def _write(folder: str, name: str, columns: dict[str, np.ndarray]) -> None:
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/{name}") as out:
        for key, values in columns.items():
            data = pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True)
            out.write(f"{key} {values.dtype.str} {len(values)} {len(data)}\n".encode().ljust(64))
            out.write(data)


def _read(folder: str, name: str, keys: set[str]) -> dict[str, np.ndarray]:
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder)
    out = {}
    with files.open_input_file(f"{path}/{name}") as f:
        size = f.size()
        at = 0
        while at < size:
            key, kind, n, length = f.read_at(64, at).decode().split()
            if key in keys:
                raw = int(n) * np.dtype(kind).itemsize
                data = pa.decompress(f.read_at(int(length), at + 64), decompressed_size=raw, codec="zstd", asbytes=True) if raw else b""
                out[key] = np.frombuffer(data, dtype=kind)
            at += 64 + int(length)
    return out


def piece_ids(tokenize: Callable[[str], bytes], id_sizes: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the ids of the pieces, one piece after the other, and their numbers); ``id_sizes``: how many bytes an id stands for.

    Pieces that end with a visible ASCII character, and begin with one or a space before one, are
    tokenized as lines of one text: a line's end between such is an id of its own, and the bytes of
    the ids tell where lines end.
    """
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    b, ends = np.frombuffer(b"".join([*pieces, b"\0\0"]), dtype=np.uint8), np.cumsum(sizes)
    visible, space = (b > 32) & (b < 127), b[ends - sizes] == 32
    line = (sizes > space) & visible[ends - sizes + space] & visible[ends - 1]
    alone = [tokenize(pieces[i].decode()) for i in np.flatnonzero(~line)]
    ids = np.frombuffer(tokenize(b"\n".join(compress(pieces, line.tolist())).decode()), dtype="<u4")
    ends = np.searchsorted(np.cumsum(id_sizes[ids]), np.cumsum(sizes[line] + 1) - 1, side="right")
    counts = np.empty(len(pieces), dtype=np.int64)
    counts[line] = np.diff(ends, prepend=-1) - 1
    counts[~line] = [len(i) // 4 for i in alone]
    flat, inside = np.empty(counts.sum(), dtype=np.uint16), np.repeat(line, counts)
    flat[inside] = np.delete(ids, ends[:-1])
    flat[~inside] = np.frombuffer(b"".join(alone), dtype="<u4")
    return flat, counts


def contents(tokenize: Callable[[str], bytes], id_sizes: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(ids, their numbers by text, hashes of words, their numbers by text): each distinct part of the texts is looked at once."""
    data, starts, ends, first = part_places(texts)
    which, parts = distinct_parts(data, starts, ends)
    data, starts, ends, begins = part_places(parts, within_words=True)
    inner, pieces = distinct_parts(data, starts, ends)
    ids, n_ids = spread(*piece_ids(tokenize, id_sizes, pieces), inner)
    ids, n_ids = spread(ids, np.add.reduceat(n_ids, begins), which)
    words, places = word_places(data)
    words, n_words = spread(words.view(np.int64), np.diff(np.searchsorted(places, np.append(starts[begins[1:]], len(data))), prepend=0), which)
    return ids, np.add.reduceat(n_ids, first), words, np.add.reduceat(n_words, first)


def blocks(docs: DataFrame, folder: str, ranks_path: str | None = None) -> DataFrame:
    """Writes the blocks; one row for each: block, docs, train_tokens, words (of its dictionary)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = ranks_path or packing.default_ranks()
        tokenize, id_sizes = packing.encoder(path), packing.id_sizes(path)

        def flush():
            docs = [d for d, _ in part]
            rows = np.array([held_out(d) for d in docs], dtype=bool)
            ids, lengths, words, sizes = contents(tokenize, id_sizes, [t for _, t in part])
            number, keys = pd.factorize(np.append(words, END_WORD))
            order = np.argsort(keys)
            keys, number = keys[order], np.argsort(order)[number]
            every = np.arange(len(part))
            doc = np.append(np.repeat(every, sizes), every)
            number = np.append(number[:-1], np.full(len(part), number[-1]))
            train = np.bincount(number[~rows[doc]], minlength=len(keys))
            # the words of a text in any order: sorted numbers, as differences, take less room
            order = np.sort(doc << 32 | number) & 0xFFFFFFFF
            name = uuid.uuid4().hex
            _write(folder, name, {
                "doc_id": np.array([-1 if d is None else d for d in docs], dtype=np.int64), "null_id": np.array([d is None for d in docs]),
                "held_out": rows, "sizes": sizes + 1, "keys": keys, "train": train.astype(np.uint32), "words": np.diff(order, prepend=0).astype(np.int32),
                "lengths": lengths, "ids": ids,
            })
            return pd.DataFrame({"block": [name], "docs": [len(part)], "train_tokens": [int(train.sum())], "words": [len(keys)]})

        part, size = [], 0
        for pdf in batches:
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                part.append((None if pd.isna(doc) else int(doc), (text or "").encode()))
                size += len(part[-1][1]) + 64
                if size >= BLOCK_BYTES:
                    yield flush()
                    part, size = [], 0
        if part:
            yield flush()

    return materialize(docs.select("doc_id", "text").mapInPandas(run, "block string, docs long, train_tokens long, words long"), "lm-blocks")


def id_counts(listed: DataFrame, folder: str) -> np.ndarray:
    """How often all training rows hold each id: a table of the vocabulary's size."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["block"]:
                b = _read(folder, name, {"held_out", "lengths", "ids"})
                train = ~b["held_out"]
                n = np.bincount(b["ids"][np.repeat(train, b["lengths"])], minlength=VOCABULARY + 1)
                n[END] = train.sum()
                keys = np.flatnonzero(n)
                yield pd.DataFrame({"id": keys.astype(np.int32), "n": n[keys]})

    counts = np.zeros(VOCABULARY + 1, dtype=np.int64)
    for r in listed.repartition("block").mapInPandas(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return counts


# ---- the model ----


@dataclass
class Model:
    symbol: np.ndarray  # id -> row of the embedding: frequent ids have their own, others their class's
    cls: np.ndarray  # id -> class
    share: np.ndarray  # id -> log10 of its share of the class
    w: dict[str, np.ndarray]


def known_ids(counts: np.ndarray) -> np.ndarray:
    """The frequent ids, that get a class of their own contexts."""
    known = np.argsort(-counts, kind="stable")[: 4 * OWN]
    return known[counts[known] > 0]


def context_counts(left: np.ndarray, right: np.ndarray, known: np.ndarray) -> np.ndarray:
    """How often each of the known ids stands after each of the first 255, or after another."""
    column = np.full(VOCABULARY + 2, 255)
    column[known[:255]] = np.arange(len(known[:255]))
    place = np.full(VOCABULARY + 2, -1)
    place[known] = np.arange(len(known))
    use = place[right] >= 0
    return np.bincount(place[right[use]] * 256 + column[left[use]], minlength=256 * len(known)).reshape(-1, 256)


def cluster(windows: np.ndarray, counts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The classes of ids by the contexts in some windows."""
    known = known_ids(counts)
    return classes(context_counts(windows[:, :-1].ravel(), windows[:, 1:].ravel(), known), known, rng)


def classes(table: np.ndarray, known: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A class for each id: k-means over what stands before it; rare ids are the last class."""
    table = table.astype(np.float64)
    seen = table.sum(axis=1) >= 5
    cls = np.full(VOCABULARY + 1, CLASSES - 1)
    if seen.sum() > CLASSES:
        x = np.sqrt(table[seen] / table[seen].sum(axis=1, keepdims=True))
        weight = table[seen].sum(axis=1)
        centres = x[rng.choice(len(x), CLASSES - 1, replace=False, p=weight / weight.sum())] if (weight > 0).sum() >= CLASSES - 1 else x[: CLASSES - 1]
        for _ in range(12):
            label = (x @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
            for k in range(len(centres)):
                if (label == k).any():
                    centres[k] = np.average(x[label == k], axis=0, weights=weight[label == k])
        cls[known[seen]] = label
    return cls


def exponentials(a: np.ndarray, most: float) -> None:
    """In place, of what is at most ``most``."""
    if a.max(initial=0) > most:
        np.minimum(a, most, out=a)
    np.exp(a, out=a)


class Room:
    """Arrays that batches of one size use again: new ones of their size would be mapped and cleared by the system each time."""

    def __init__(self, dtype):
        self.dtype, self.kept, self.parts = dtype, {}, {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size, got = math.prod(shape), self.kept.get(name)
        if got is None or got.size < size:
            got = self.kept[name] = np.empty(size, self.dtype)
        return got[:size].reshape(shape)

    def like(self, w: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """An array of the size of all weights, and its parts in their shapes."""
        if not self.parts:
            self.flat = np.empty(sum(v.size for v in w.values()), self.dtype)
            self.parts = views(self.flat, w)
        return self.flat, self.parts


def views(flat: np.ndarray, w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Parts of one array in the shapes of ``w``."""
    ends = np.cumsum([v.size for v in w.values()])
    return {k: part.reshape(v.shape) for (k, v), part in zip(w.items(), np.split(flat, ends[:-1]), strict=True)}


def positive(f: np.ndarray, room: Room) -> None:
    """In place, nothing below 0 (an array of zeros is several times as fast as one zero)."""
    zeros = room("zeros", *f.shape)
    zeros.fill(0)
    np.maximum(f, zeros, out=f)


def _forward(w: dict[str, np.ndarray], symbols: np.ndarray) -> dict[str, np.ndarray]:
    """Masked attention over a batch of windows; logits of the class after each position."""
    c = _unbiased(w, symbols, Room(w["e"].dtype))
    return c | {"z": c["z"] + w["b"]}


def _unbiased(w: dict[str, np.ndarray], symbols: np.ndarray, room: Room) -> dict[str, np.ndarray]:
    """The pass up to the classes' logits without ``b``.

    ``a`` are exponentials and ``s`` their sums, by which not they but the fewer outputs are divided.
    """
    (m, n), size = symbols.shape, symbols.size
    x = w["e"].take(symbols, axis=0, out=room("x", m, n, DIM), mode="clip")
    x += w["p"][:n]
    rows = x.reshape(-1, DIM)
    qkv = np.matmul(rows, w["qkv"], out=room("qkv", size, 3 * DIM)).reshape(m, n, 3 * DIM)
    q, k, v = (qkv[:, :, i * DIM : (i + 1) * DIM] for i in range(3))
    a = np.matmul(q, k.transpose(0, 2, 1), out=room("a", m, n, n))
    exponentials(a, 30)
    a *= MASK[:n, :n]
    s = a.reshape(-1, n) @ np.ones((n, 1), a.dtype)
    s += 1e-30
    o = np.matmul(a, v, out=room("o", m, n, DIM)).reshape(-1, DIM)
    o /= s
    h = np.add(rows, o, out=room("h", size, DIM))
    f = np.matmul(h, w["f1"], out=room("f", size, HIDDEN))
    positive(f, room)
    g = np.matmul(f, w["f2"], out=room("g", size, DIM))
    g += h
    z = np.matmul(g, w["u"], out=room("z", size, CLASSES))
    return {"x": rows, "q": q, "k": k, "v": v, "a": a, "s": s, "o": o, "h": h, "f": f, "g": g, "z": z}


class Tables:
    """The same pass for scoring: projections of symbols and positions are looked up, not computed."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.w, self.room = w, Room(w["e"].dtype)
        self.symbol, self.position = (np.hstack((w[key] @ w["qkv"], w[key])) for key in ("e", "p"))
        self.ones = np.ones((WIDTH, 1), np.float32)
        self.bias = np.exp(np.minimum(w["b"], 20))[:, None]

    def logs(self, symbols: np.ndarray, cls: np.ndarray, wanted: np.ndarray | slice, skip: int = 0) -> np.ndarray:
        """Logarithms of the shares of classes after the wanted places, counted in the windows without their first ``skip`` positions, which are context only."""
        w, room, (m, n) = self.w, self.room, symbols.shape
        looked = self.symbol.take(symbols, axis=0, out=room("looked", m, n, 4 * DIM), mode="clip")
        looked += self.position[:n]
        q, k, v, x = (looked[:, skip * (i in (0, 3)) :, i * DIM : (i + 1) * DIM] for i in range(4))
        a = np.matmul(q, k.transpose(0, 2, 1), out=room("a", m, n - skip, n))
        exponentials(a, 30)
        a *= MASK[skip:n, :n]
        h = np.matmul(a, v, out=room("h", m, n - skip, DIM))
        h /= (a.reshape(-1, n) @ self.ones[:n] + 1e-30).reshape(m, -1, 1)
        h += x
        h = h.reshape(-1, DIM)[wanted]
        f = np.matmul(h, w["f1"], out=room("f", len(h), HIDDEN))
        positive(f, room)
        h += np.matmul(f, w["f2"], out=room("g", len(h), DIM))
        z = np.matmul(h, w["u"], out=room("z", len(h), CLASSES))
        got = np.minimum(z.reshape(-1).take(np.arange(0, z.size, CLASSES) + cls), 60) + self.w["b"].take(cls)
        exponentials(z, 60)
        return got - np.log((z @ self.bias)[:, 0] + 1e-30)


def gradients(w: dict[str, np.ndarray], inputs: np.ndarray, want: np.ndarray, room: Room | None = None) -> dict[str, np.ndarray]:
    """Of the mean negative log probability of the classes wanted (-1: none) after each position; parts of what ``room.like(w)`` gives."""
    room = room or Room(w["e"].dtype)
    c, want = _unbiased(w, inputs, room), want.ravel()
    (m, n), size = inputs.shape, inputs.size
    _, grad = room.like(w)
    # shares of classes are exponentials by their sums; rows are weighed where they are narrow, classes in the products
    e, bias = c["z"], np.exp(np.minimum(w["b"], 20))
    exponentials(e, 60)
    sums = e @ bias[:, None]
    sums += 1e-30
    real, want = want >= 0, np.maximum(want, 0)
    e.reshape(-1)[np.arange(size) * CLASSES + want] -= sums[:, 0] / bias[want]
    scale = real[:, None] / sums
    scale /= max(1, np.count_nonzero(real))
    scale = scale.astype(e.dtype, copy=False)
    # a product of many rows is faster with the wider matrix first
    grad["u"][:] = (e.T @ np.multiply(c["g"], scale, out=room("narrow", size, DIM))).T * bias
    np.multiply(np.matmul(scale[:, 0], e), bias, out=grad["b"])
    dg = np.matmul(e, (w["u"] * bias).T, out=room("dg", size, DIM))
    dg *= scale
    np.matmul(c["f"].T, dg, out=grad["f2"])
    df = np.matmul(dg, w["f2"].T, out=room("df", size, HIDDEN))
    df *= c["f"] > 0
    grad["f1"][:] = (df.T @ c["h"]).T
    dh = np.matmul(df, w["f1"].T, out=room("dh", size, DIM))
    dh += dg
    # through the softmax: a row's mean of da by its shares is the product of dh and the row's output
    do = np.divide(dh, c["s"], out=room("narrow", size, DIM))
    da = np.matmul(do.reshape(m, n, DIM), c["v"].transpose(0, 2, 1), out=room("da", m, n, n))
    da -= np.einsum("ij,ij->i", do, c["o"]).reshape(m, n, 1)
    da *= c["a"]
    dqkv, part = room("dqkv", m, n, 3 * DIM), room("part", m, n, DIM)
    dqkv[:, :, :DIM] = np.matmul(da, c["k"], out=part)
    dqkv[:, :, DIM : 2 * DIM] = np.matmul(da.transpose(0, 2, 1), c["q"], out=part)
    dqkv[:, :, 2 * DIM :] = np.matmul(c["a"].transpose(0, 2, 1), do.reshape(m, n, DIM), out=part)
    dqkv = dqkv.reshape(-1, 3 * DIM)
    grad["qkv"][:] = (dqkv.T @ c["x"]).T
    dx = np.matmul(dqkv, w["qkv"].T, out=room("dx", size, DIM))
    dx += dh
    grad["p"][n:] = 0
    np.matmul(np.ones(m, dx.dtype), dx.reshape(m, -1), out=grad["p"][:n].reshape(-1))
    symbols = inputs.ravel().astype(np.int64)
    for i, column in enumerate(dx.T.astype(np.float64)):
        grad["e"][:, i] = np.bincount(symbols, weights=column, minlength=len(w["e"]))
    return grad


def train(windows: np.ndarray, symbols: np.ndarray, target: np.ndarray, steps: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Adam over random batches of windows, from random weights."""
    shapes = {"e": (OWN + CLASSES + 1, DIM), "p": (WIDTH, DIM), "qkv": (DIM, 3 * DIM), "f1": (DIM, HIDDEN), "f2": (HIDDEN, DIM), "u": (DIM, CLASSES)}
    w = {k: rng.normal(0, 0.3 if k == "e" else 0.25, s).astype(np.float32) for k, s in shapes.items()} | {"b": np.zeros(CLASSES, np.float32)}
    picks = (rng.integers(len(windows), size=BATCH) for _ in range(steps if len(windows) else 0))
    return _adam(w, symbols, target, picks, steps, 0.01)


def _adam(w: dict[str, np.ndarray], symbols: np.ndarray, target: np.ndarray, picks: Iterable[np.ndarray], steps: int, top: float) -> dict[str, np.ndarray]:
    """Steps over all weights as one array, of which ``w`` becomes views."""
    flat = np.concatenate([v.ravel() for v in w.values()])
    w, room = views(flat, w), Room(flat.dtype)
    m, s, change = (np.zeros_like(flat) for _ in range(3))
    for step, pick in enumerate(picks, 1):
        rate = top * min(1.0, step / 50) * (1 - 0.9 * step / steps)
        gradients(w, symbols[pick], target[pick], room)
        g, _ = room.like(w)
        m *= 0.9
        m += np.multiply(g, 0.1, out=change)
        s *= 0.99
        g *= g
        s += np.multiply(g, 0.01, out=change)
        np.sqrt(np.divide(s, 1 - 0.99**step, out=change), out=change)
        change += 1e-8
        np.divide(m, change, out=change)
        flat -= np.multiply(change, rate / (1 - 0.9**step), out=change)
    return w


def all_windows(model: Model, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and the classes wanted after them: windows in which every id and end of the texts is wanted once."""
    flat, before, starts = sequence(ids, lengths)
    counts = -(-(lengths + 1) // WIDTH)
    doc = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    place = (starts[doc] + nth * WIDTH)[:, None] + np.arange(WIDTH)
    valid = place < starts[doc + 1][:, None]
    np.minimum(place, starts[doc + 1][:, None] - 1, out=place)
    return model.symbol[before[place]], np.where(valid, model.cls[flat[place]], -1)


def pass_over(model: Model, symbols: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
    """The model's weights after one more pass over all the windows."""
    order = np.random.default_rng(len(symbols)).permutation(len(symbols))
    picks = [order[at : at + BATCH] for at in range(0, len(order), BATCH)]
    return _adam({k: v.copy() for k, v in model.w.items()}, symbols, target, picks, len(picks), PASS_RATE)


def sample_windows(docs: DataFrame, sample_docs: int, windows: int, ranks_path: str | None = None) -> np.ndarray:
    """Windows of WIDTH + 1 ids (start and end included; -1 pads) at random places of sampled training texts."""
    n = docs.count()
    chosen = docs.select("doc_id", "text").filter(F.pmod(F.xxhash64("doc_id", F.lit("lm")), F.lit(1 << 30)) < int(min(1.0, sample_docs / max(n, 1)) * (1 << 30)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenize = packing.encoder(ranks_path or packing.default_ranks())
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                if held_out(None if pd.isna(doc) else int(doc)):
                    continue
                data = tokenize(text or "")
                ids = np.concatenate(([END + 1], np.frombuffer(data, dtype="<u4").astype(np.int64), [END]))
                rng = np.random.default_rng(zlib.crc32(data))
                for _ in range(min(windows, 1 + len(ids) // WIDTH)):
                    at = int(rng.integers(max(1, len(ids) - WIDTH)))
                    part = ids[at : at + WIDTH + 1]
                    out.append(np.concatenate((part, np.full(WIDTH + 1 - len(part), -1))).tolist())
            yield pd.DataFrame({"ids": out})

    rows = chosen.mapInPandas(run, "ids array<long>").toPandas()["ids"]  # sample_docs * windows rows at most
    got = np.array(rows.tolist(), dtype=np.int64).reshape(-1, WIDTH + 1)
    return got[np.lexsort(got.T[::-1])]


def training_ids(folder: str, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a block's training rows, one text after the other, and their lengths."""
    b = _read(folder, name, {"held_out", "lengths", "ids"})
    train = ~b["held_out"]
    return b["ids"][np.repeat(train, b["lengths"])].astype(np.int64), b["lengths"][train]


def _tasks(listed: DataFrame, of_core: int = 4) -> int:
    return max(1, min(listed.count(), of_core * listed.sparkSession.sparkContext.defaultParallelism))


def _summed(listed: DataFrame, run: Callable[[Iterator[str]], np.ndarray], size: int) -> np.ndarray:
    """The sum over all blocks of what ``run`` makes of some of them: ``size`` whole numbers."""
    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = run(name for pdf in batches for name in pdf["block"])
        keys = np.flatnonzero(got)
        yield pd.DataFrame({"i": keys.astype(np.int32), "n": got[keys]})

    rows = listed.select("block").repartition(_tasks(listed)).mapInPandas(part, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, dtype=np.int64)
    out[rows["i"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return out


def all_contexts(listed: DataFrame, folder: str, known: np.ndarray) -> np.ndarray:
    """``context_counts`` of all training rows: a table of the vocabulary's size."""
    def run(names: Iterator[str]) -> np.ndarray:
        table = np.zeros((len(known), 256), dtype=np.int64)
        for name in names:
            flat, before, _ = sequence(*training_ids(folder, name))
            table += context_counts(before, flat, known)
        return table.ravel()

    return _summed(listed, run, 256 * len(known)).reshape(-1, 256)


def trained(listed: DataFrame, folder: str, start: Model) -> dict[str, np.ndarray]:
    """The mean of the weights after a pass over each block's training rows, by windows; sums are exact in any order."""
    shared = listed.sparkSession.sparkContext.broadcast(packed(start))
    ends = np.cumsum([v.size for v in start.w.values()])

    def run(names: Iterator[str]) -> np.ndarray:
        model, total = unpacked(shared.value), np.zeros(ends[-1] + 1, dtype=np.int64)
        for name in names:
            symbols, target = all_windows(model, *training_ids(folder, name))
            if len(symbols):
                w = pass_over(model, symbols, target)
                flat = np.concatenate([w[k].ravel() for k in model.w]).astype(np.float64)
                total += np.append(np.rint(flat * (len(symbols) * 2.0**20)).astype(np.int64), len(symbols))
        return total

    total = _summed(listed, run, ends[-1] + 1)
    if not total[-1]:
        return start.w
    parts = np.split(total[:-1] / (total[-1] * 2.0**20), ends[:-1])
    return {k: part.reshape(v.shape).astype(np.float32) for (k, v), part in zip(start.w.items(), parts, strict=True)}


def packed(model: Model) -> bytes:
    sent = io.BytesIO()
    np.savez(sent, symbol=model.symbol, cls=model.cls, share=model.share, **{f"w_{k}": v for k, v in model.w.items()})
    return sent.getvalue()


def unpacked(sent: bytes) -> Model:
    with np.load(io.BytesIO(sent)) as f:
        return Model(f["symbol"], f["cls"], f["share"], {k[2:]: f[k] for k in f.files if k.startswith("w_")})


def fit(docs: DataFrame, listed: DataFrame, folder: str, counts: np.ndarray, *, sample_docs: int = 3_000, windows: int = 12, steps: int = 800, seed: int = 3, ranks_path: str | None = None) -> Model:
    rng = np.random.default_rng(seed)
    got = sample_windows(docs, sample_docs, windows, ranks_path)
    known = known_ids(counts)
    cls = classes(all_contexts(listed, folder, known), known, rng)
    symbol = np.append(OWN + cls, OWN + CLASSES)  # the last is the start
    own = np.argsort(-counts, kind="stable")[:OWN]
    symbol[own] = np.arange(OWN)
    inputs = symbol[np.maximum(got[:, :-1], 0)]
    target = np.where(got[:, 1:] >= 0, cls[np.clip(got[:, 1:], 0, END)], -1)
    w = train(got, inputs, target, steps, rng)
    plus = counts + 1.0
    share = np.log10(plus / np.bincount(cls, weights=plus, minlength=CLASSES)[cls])
    start = Model(symbol.astype(np.int32), cls.astype(np.int16), share.astype(np.float64), w)
    return replace(start, w=trained(listed, folder, start))


#: Ids scored at a time (a longer text by itself).
SLICE = 1 << 18


def text_scores(model: Model, ids: np.ndarray, lengths: np.ndarray, batch: int = 128) -> np.ndarray:
    """log10 probability of each text: ``ids`` of all texts without start and end, one after the other."""
    out, ends = [np.zeros(0)], np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        base = ends[at] - lengths[at]
        to = max(at + 1, int(np.searchsorted(ends, base + SLICE, side="right")))
        out.append(_scores(model, ids[base : ends[to - 1]], lengths[at:to], batch))
        at = to
    return np.concatenate(out)


def sequence(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' ids with an end after each, the id (or start) before each of them, and where the texts start."""
    starts = np.concatenate(([0], np.cumsum(lengths + 1)))
    flat = np.full(starts[-1], END, dtype=np.int64)
    inside = np.ones(starts[-1], dtype=bool)
    inside[starts[1:] - 1] = False
    flat[inside] = ids
    before = np.full(starts[-1], END + 1, dtype=np.int64)
    before[1:] = flat[:-1]
    before[starts[:-1]] = END + 1
    return flat, before, starts


def _scores(model: Model, ids: np.ndarray, lengths: np.ndarray, batch: int) -> np.ndarray:
    total = lengths + 1  # with the end, what is predicted
    flat, before, starts = sequence(ids, lengths)
    symbols, cls = model.symbol[before], model.cls[flat].astype(np.int64)
    scored = model.share[flat]
    # windows of a text begin at 0, STRIDE, ...; those after the first score what the one before didn't hold
    counts = 1 + np.maximum(0, -(-(total - WIDTH) // STRIDE))
    doc = np.repeat(np.arange(len(total)), counts)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    first = starts[doc] + nth * STRIDE
    last = starts[doc + 1]
    offsets, tables, later, full = np.arange(WIDTH), Tables(model.w), nth > 0, last - first >= WIDTH
    for skip, windows in ((0, ~later & full), (0, ~later & ~full), (WIDTH - STRIDE, later & full), (WIDTH - STRIDE, later & ~full)):
        windows = np.flatnonzero(windows)
        for at in range(0, len(windows), batch):
            part = windows[at : at + batch]
            place = first[part, None] + offsets
            wanted: np.ndarray | slice = slice(None)
            if not full[part[0]]:
                wanted = np.flatnonzero(place[:, skip:] < last[part, None])
                np.minimum(place, last[part, None] - 1, out=place)
            spot = place[:, skip:].ravel()[wanted]
            scored[spot] += tables.logs(symbols[place], cls[spot], wanted, skip) / math.log(10)
    return np.add.reduceat(scored, starts[:-1])


# ---- scores ----


def word_counts(listed: DataFrame, folder: str, lot_words: int = LOT_WORDS) -> DataFrame:
    """What all training rows hold of the words of each block: block, lot, c (counts by word, as bytes), types (words counted here first, those that occur).

    Dictionaries are sorted by hash and cut into lots, ranges of hashes that hold about ``lot_words``
    entries of all blocks; a lot's parts meet in one group, where a word has one entry a block.
    """
    lots = max(1, -(-(listed.agg(F.sum("words")).first()[0] or 0) // lot_words))
    bounds = np.array([-(1 << 63) + (i << 64) // lots for i in range(1, lots)], dtype=np.int64)

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["block"]:
                b = _read(folder, name, {"keys", "train"})
                at = np.searchsorted(b["keys"], bounds)
                keys, train = ([part.tobytes() for part in np.split(b[k], at)] for k in ("keys", "train"))
                yield pd.DataFrame({"block": name, "lot": np.arange(lots, dtype=np.int32), "keys": keys, "train": train})

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        number, keys = pd.factorize(np.frombuffer(b"".join(pdf["keys"]), dtype=np.int64))
        sums = np.zeros(len(keys), dtype=np.int64)
        np.add.at(sums, number, np.frombuffer(b"".join(pdf["train"]), dtype=np.uint32).astype(np.int64))
        parts = np.split(sums[number], np.cumsum([len(k) // 8 for k in pdf["keys"]])[:-1])
        types = np.zeros(len(pdf), dtype=np.int64)
        types[0] = np.count_nonzero(sums)
        return pd.DataFrame({"block": pdf["block"], "lot": pdf["lot"], "c": [c.tobytes() for c in parts], "types": types})

    rows = listed.select("block").repartition(_tasks(listed)).mapInPandas(entries, "block string, lot int, keys binary, train binary")
    return rows.groupBy("lot").applyInPandas(summed, "block string, lot int, c binary, types long")


def score(docs: DataFrame, *, ranks_path: str | None = None, **options) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    folder = fresh(spark, "lm-texts")
    listed = blocks(docs, folder, ranks_path)
    model = fit(docs, listed, folder, id_counts(listed, folder), ranks_path=ranks_path, **options)
    shared = spark.sparkContext.broadcast(packed(model))  # of the vocabulary's size

    def scored(pdf: pd.DataFrame) -> pd.DataFrame:
        model = unpacked(shared.value)
        b = _read(folder, pdf["block"].iloc[0], {"doc_id", "null_id", "held_out", "sizes", "words", "lengths", "ids"})
        c = np.frombuffer(b"".join(pdf.sort_values("lot")["c"]), dtype=np.int64)
        words = np.cumsum(b["words"].astype(np.int64))
        starts = np.cumsum(b["sizes"]) - b["sizes"]
        out = pd.DataFrame({
            "doc_id": pd.array(b["doc_id"], dtype="Int64"), "held_out": b["held_out"], "n_tokens": b["sizes"],
            "n_known": np.add.reduceat((c > 0).astype(np.int64)[words], starts), "logs": np.add.reduceat(np.log10(c + 1.0)[words], starts),
            "score": text_scores(model, b["ids"], b["lengths"]), "types": 0,
        })
        out.loc[b["null_id"], "doc_id"] = pd.NA
        out.loc[0, "types"] = int(pdf["types"].sum())
        return out

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, types long"
    counted = word_counts(listed, folder).repartition(_tasks(listed, 16), "block")
    found = materialize(counted.groupBy("block").applyInPandas(scored, schema), "lm-scores")
    tokens = listed.agg(F.sum("train_tokens")).first()[0] or 0
    types = found.agg(F.sum("types")).first()[0] or 0
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(tokens + types + 1)))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
