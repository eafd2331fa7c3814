"""Hashes of the words and word n-grams of texts, computed over whole arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
BLOCK = 1 << 19  # bytes hashed at a time
SPACES = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=U)
    out[1:] = U(base)
    return np.multiply.accumulate(out)


_POWERS: list[np.ndarray] = []


def _fill_powers() -> None:
    if not _POWERS:
        _POWERS.extend((_powers(BASE, 2 * BLOCK), _powers(INVERSE, 2 * BLOCK)))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (multiply and shift rounds)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _block(data: bytes, at: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the words of a block that begins and ends between words."""
    _fill_powers()
    b = np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    edges = np.concatenate((edges if len(b) and space[0] else np.concatenate(([0], edges)), [len(b)]))
    if not len(b) or len(edges) < 2:
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    starts, ends = edges[: len(edges) // 2 * 2 : 2], edges[1::2]
    low = np.where((b >= 65) & (b <= 90), b | 32, b).astype(U) + U(1)
    low *= _POWERS[0][: len(b)]
    sums = np.concatenate((np.zeros(1, dtype=U), np.cumsum(low, dtype=U)))
    return mixed((sums[ends] - sums[starts]) * _POWERS[1][starts] + (ends - starts).astype(U)), starts


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the words of UTF-8 bytes, A-Z lower-cased, words parted by ASCII white space."""
    out, places, at = [np.zeros(0, dtype=U)], [np.zeros(0, dtype=np.int64)], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        if end < len(data):  # cut at white space
            cut = max(data.rfind(c, at, end) for c in SPACES)
            if cut < at:  # a word longer than a block, by itself
                end = min((i for i in (data.find(c, end) for c in SPACES) if i >= 0), default=len(data))
                out.append(np.array([xxhash.xxh64_intdigest(data[at:end].lower())], dtype=U))
                places.append(np.array([at]))
                at = end
                continue
            end = cut + 1
        hashes, starts = _block(data, at, end)
        out.append(hashes)
        places.append(starts + at)
        at = end
    return np.concatenate(out), np.concatenate(places)


def word_hashes(data: bytes) -> np.ndarray:
    """A hash for each word."""
    return word_places(data)[0]


def part_places(texts: list[bytes], within_words: bool = False) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, ends, texts' first parts): texts cut before each single space between two visible ASCII characters.

    No word, and no piece of a byte-level BPE, goes across such a cut.  A text has one part at least.
    ``within_words`` cuts further where pieces end, but words needn't: between an ASCII letter and
    another visible ASCII character, and after a single line's end between two of these.
    """
    data = b"\n".join([*texts, b""])
    b = np.frombuffer(data, dtype=np.uint8)
    visible = (b > 32) & (b < 127)
    cut = np.zeros(len(b) + 1, dtype=bool)
    cut[1:-2] = (b[1:-1] == 32) & visible[:-2] & visible[2:]
    if within_words:
        letter = visible & ((b | 32) >= 97) & ((b | 32) <= 122)
        cut[1:-1] |= letter[:-1] & ~letter[1:] & visible[1:]
        cut[2:-1] |= visible[:-2] & (b[1:-1] == 10) & visible[2:]
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    heads = np.cumsum(sizes) - sizes
    cut[heads] = True
    starts = np.flatnonzero(cut)
    first = np.searchsorted(starts, heads)
    ends = np.append(starts[1:], len(b))
    ends[np.append(first[1:], len(starts)) - 1] -= 1  # without the line's end after each text
    return data, starts, ends, first


def part_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each part, of its bytes as they are."""
    _fill_powers()
    out, b, at = np.zeros(len(starts), dtype=U), np.frombuffer(data, dtype=np.uint8), 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + BLOCK, side="right")))
        if ends[at] - base > BLOCK:
            out[at] = xxhash.xxh64_intdigest(data[base : ends[at]])
        else:
            s, e = starts[at:to] - base, ends[at:to] - base
            low = b[base : ends[to - 1]].astype(U)
            low += U(1)
            low *= _POWERS[0][: len(low)]
            sums = np.zeros(len(low) + 1, dtype=U)
            np.cumsum(low, out=sums[1:])
            out[at:to] = mixed((sums[e] - sums[s]) * _POWERS[1][s] + (e - s).astype(U))
        at = to
    return out


def distinct_parts(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(each part's number, the parts by number)."""
    which, _ = pd.factorize(part_hashes(data, starts, ends))
    example = np.empty(which.max() + 1, dtype=np.int64)
    example[which[::-1]] = np.arange(len(which))[::-1]
    return which, [data[s:e] for s, e in zip(starts[example].tolist(), ends[example].tolist(), strict=True)]


def spread(values: np.ndarray, counts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the values of the groups named by ``which``, one after the other, and their counts); ``counts``: how many values each group has."""
    n = counts[which]
    offsets = (np.cumsum(counts) - counts)[which]
    return values[np.repeat(offsets - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    k = min(n, len(words))
    total = np.zeros(len(words) - k + 1, dtype=U)
    for j in range(k):
        total = mixed(total + words[j : len(words) - k + 1 + j])
    return total + U(k)


def _set(grams: np.ndarray) -> np.ndarray:
    grams = np.sort(grams)
    return grams[np.concatenate(([True], grams[1:] != grams[:-1]))] if len(grams) else grams


def gram_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """For each text the set of its word n-grams as sorted hashes; fewer words than n make one n-gram.

    Short texts are hashed together, a block at a time.
    """
    out: list[np.ndarray] = [np.zeros(0, dtype=U)] * len(texts)
    part: list[tuple[int, bytes]] = []
    size = 0

    def flush():
        offsets = np.cumsum([0] + [len(d) + 1 for _, d in part])
        words, starts = _block(b"\n".join(d for _, d in part), 0, int(offsets[-1]) - 1)
        doc = np.searchsorted(offsets, starts, side="right") - 1
        bounds = np.searchsorted(doc, np.arange(len(part) + 1))
        grams = _grams(words, n) if len(words) >= n else np.zeros(0, dtype=U)
        for j, (i, _) in enumerate(part):
            a, b = bounds[j], bounds[j + 1]
            if b - a >= n:
                out[i] = _set(grams[a : b - n + 1])
            elif b > a:
                out[i] = _set(_grams(words[a:b], n))

    for i, text in enumerate(texts):
        data = (text or "").encode()
        if len(data) > BLOCK // 2:
            words = word_hashes(data)
            out[i] = _set(_grams(words, n)) if len(words) else words
            continue
        if part and size + len(data) > BLOCK:
            flush()
            part, size = [], 0
        part.append((i, data))
        size += len(data) + 1
    if part:
        flush()
    return out
