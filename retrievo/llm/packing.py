"""Operator 9: packing documents into fixed windows by best-fit decreasing.

1. Documents are tokenized in Python batches.  Byte-level BPE never joins a space to what stands
   before it, so very long texts go to the tokenizer in parts that begin with a single space.
2. An overlong document is cut into full windows first, each a sequence of its own; what is left is
   a piece shorter than a window.
3. Pieces are dealt to groups by a hash of their place in the table of pieces, and each group is
   packed by best-fit decreasing: a segment tree indexed by remaining capacity finds the tightest
   open window.  A group has about ``group_pieces`` pieces, so no task grows with the input, and
   thousands of pieces a group leave little to gain from larger ones.

Only (doc_id, start, length, digest) rows of pieces shorter than a window are shuffled; token ids
stay where they are made, unless asked for with ``keep_ids``.

Ids are those of the tokenizer file as ``encode(text, add_special_tokens=False)`` gives them: strings
of its added tokens, such as ``<|endoftext|>``, have their own ids.

Defined cases: null text is empty text, a document of one id (the end id); repeated rows are packed
as separate pieces; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrievo.llm.storage import materialize

#: Where a long text is cut: before a single space between two other characters.
CUT = re.compile(r"(?<=\S) (?=\S)")
LONG = 1 << 20


def encoder(ranks_path: str, pattern: str | None = None, added: dict[str, int] | None = None):
    """text -> ids as little-endian 32-bit bytes, for a byte-level BPE given as ranks, and the ids of added tokens."""
    import tiktoken

    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    added = {token: np.array([i], dtype="<u4").tobytes() for token, i in (added or {}).items()}
    marks = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def ordinary(text: str) -> bytes:
        found, at = array("I"), 0
        while at < len(text):
            cut = CUT.search(text, at + LONG) if len(text) - at > LONG else None
            end = cut.start() if cut else len(text)
            found.extend(encoding.encode_ordinary(text[at:end] if at or cut else text))
            at = end
        if sys.byteorder == "big":
            found.byteswap()
        return found.tobytes()

    def ids(text: str) -> bytes:
        if marks and marks.search(text):
            return b"".join(added[part] if part in added else ordinary(part) for part in marks.split(text))
        return ordinary(text)

    return ids


def id_sizes(ranks_path: str) -> np.ndarray:
    """How many bytes each id of the ranks stands for."""
    with open(ranks_path, "rb") as lines:
        sizes = {int(b): len(base64.b64decode(a)) for a, b in map(bytes.split, lines)}
    out = np.zeros(max(sizes) + 1, dtype=np.int64)
    out[list(sizes)] = list(sizes.values())
    return out


def default_added() -> dict[str, int]:
    """The added tokens of the default tokenizer."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, *, window: int = 1024, end_id: int = 0, ranks_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Full windows and the shorter rest of every document, with the CRC-32 of their ids (and the ids)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = encoder(ranks_path) if ranks_path else encoder(default_ranks(), added=default_added())
        end = np.array([end_id], dtype="<u4").tobytes()
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                data = ids(text or "") + end
                n = len(data) // 4
                view = memoryview(data)
                for start in range(0, n, window):
                    part = view[4 * start : 4 * min(start + window, n)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), n, *([bytes(part)] if keep_ids else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])])

    return docs.select("doc_id", "text").mapInPandas(run, PIECES + (", ids binary" if keep_ids else ""))


class Tightest:
    """Segment tree over remaining capacities 0..window: which have an open window, tightest first."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, sequence: int) -> None:
        self.open[capacity].append(sequence)
        i = capacity + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, sequence) with the least capacity of at least ``need``."""
        i = need + self.size
        if not self.count[i]:
            while i > 1 and not (i % 2 == 0 and self.count[i + 1]):  # up to the first subtree on the right
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.size
        while i:
            self.count[i] -= 1
            i >>= 1
        return capacity, self.open[capacity].pop()


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """Sequence and offset for each of the lengths, given longest first, and the number of sequences."""
    tree, sequences, offsets, n = Tightest(window), [], [], 0
    for length in lengths:
        if found := tree.take(length):
            room, sequence = found
        else:
            room, sequence, n = window, n, n + 1
        sequences.append(sequence)
        offsets.append(window - room)
        if room > length:
            tree.put(room - length, sequence)
    return sequences, offsets, n


def pack(docs: DataFrame, *, window: int = 1024, end_id: int = 0, group_pieces: int = 8192, ranks_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    cut = materialize(pieces(docs, window=window, end_id=end_id, ranks_path=ranks_path, keep_ids=keep_ids), "pack-pieces")
    cut = cut.withColumn("place", F.monotonically_increasing_id())  # of a written table, so it stays
    groups = max(1, -(-cut.filter(F.col("length") < window).count() // group_pieces))

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        sequences, offsets, _ = best_fit(pdf["length"].tolist(), window)
        base = int(key[0]) << 40
        pdf["sequence_id"] = [base + s for s in sequences]
        pdf["offset"] = offsets
        return pdf.drop(columns="lot")

    schema = PIECES + (", ids binary" if keep_ids else "") + ", sequence_id long, offset long"
    rest = cut.filter(F.col("length") < window).withColumn("lot", F.pmod(F.xxhash64("place"), F.lit(groups))).drop("place")
    whole = cut.filter(F.col("length") == window).withColumn("sequence_id", F.lit(1 << 62) + F.col("place")).withColumn("offset", F.lit(0).cast("long"))
    return rest.groupBy("lot").applyInPandas(fill, schema).unionByName(whole.drop("place"))
