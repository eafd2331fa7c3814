"""Pair scorers: a model with a yes and a no logit reads (query, document) in batches of like length.

A model is any picklable object with ``encode(str) -> sequence of ids`` and ``logits(queries, documents)``
over padded id matrices (0 pads) that returns a (pairs, 2) array: yes, no.  It is broadcast once and
called on batches whose padded size stays under a budget, so one long text doesn't pad a whole batch.
A document longer than ``window`` ids is read in windows; its score is the greatest of theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame


class YesNoModel(Protocol):
    def encode(self, text: str) -> np.ndarray: ...

    def logits(self, queries: np.ndarray, documents: np.ndarray) -> np.ndarray: ...


@dataclass(frozen=True)
class OverlapModel:
    """Logits by the share of distinct query tokens that a document holds; tokens are ids by hash."""

    pattern: str = r"[\p{L}\p{N}_]{2,}"
    gain: float = 6.0
    bias: float = -2.0

    def encode(self, text: str) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(w) | 1 for w in regex.findall(self.pattern, (text or "").lower())], dtype=np.uint64)

    def logits(self, queries: np.ndarray, documents: np.ndarray) -> np.ndarray:
        first = np.ones(queries.shape, dtype=bool)  # of equal ids of a query one counts
        order = np.argsort(queries, axis=1, kind="stable")
        ranked = np.take_along_axis(queries, order, axis=1)
        np.put_along_axis(first, order[:, 1:], ranked[:, 1:] != ranked[:, :-1], axis=1)
        counts = first & (queries != 0)
        found = (queries[:, :, None] == documents[:, None, :]).any(axis=2)
        share = (found & counts).sum(axis=1) / np.maximum(counts.sum(axis=1), 1)
        return np.column_stack((self.gain * share + self.bias, np.zeros(len(share))))


def yes(logits: np.ndarray) -> np.ndarray:
    """Softmax over the two logits: the probability of yes."""
    raised = np.exp(logits - logits.max(axis=1, keepdims=True))
    return raised[:, 0] / raised.sum(axis=1)


def like_length(queries: list[np.ndarray], documents: list[np.ndarray], cells: int) -> Iterator[np.ndarray]:
    """Positions of pairs in batches by length, so that pairs * longest query * longest document stays under ``cells``."""
    lengths = np.array([(max(len(d), 1), max(len(q), 1)) for q, d in zip(queries, documents, strict=True)], dtype=np.int64).reshape(-1, 2)
    order = np.lexsort((lengths[:, 1], lengths[:, 0]))
    batch, widest, longest = [], 0, 0
    for i in order:
        d, q = lengths[i]
        if batch and (len(batch) + 1) * max(widest, q) * max(longest, d) > cells:
            yield np.array(batch)
            batch, widest, longest = [], 0, 0
        batch.append(i)
        widest, longest = max(widest, q), max(longest, d)
    if batch:
        yield np.array(batch)


def padded(ids: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(ids), max(1, max(map(len, ids), default=1))), dtype=np.uint64)
    for row, x in zip(out, ids, strict=True):
        row[: len(x)] = x
    return out


def score_pairs(pairs: DataFrame, queries: DataFrame, docs: DataFrame, model: YesNoModel, window: int = 512, cells: int = 1 << 22) -> DataFrame:
    """query_id, doc_id, score of distinct ``pairs(query_id, doc_id)``; texts come from ``queries(query_id, text)`` and ``docs(doc_id, text)``."""
    shared = pairs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = shared.value
        for pdf in batches:
            known: dict[str, np.ndarray] = {}  # texts of a batch are encoded once
            encode = lambda text: known.setdefault(text, reader.encode(text)) if text not in known else known[text]
            owner, asked, parts = [], [], []
            for i, (q, d) in enumerate(zip(pdf["q"], pdf["d"], strict=True)):
                query, document = encode(q or ""), encode(d or "")
                for at in range(0, max(len(document), 1), window):
                    owner.append(i)
                    asked.append(query)
                    parts.append(document[at : at + window])
            scores = np.zeros(len(pdf))
            for some in like_length(asked, parts, cells):
                p = yes(reader.logits(padded([asked[i] for i in some]), padded([parts[i] for i in some])))
                np.maximum.at(scores, np.array(owner)[some], p)
            yield pd.DataFrame({"query_id": pdf["query_id"], "doc_id": pdf["doc_id"], "score": scores})

    texts = pairs.select("query_id", "doc_id").distinct().join(queries.selectExpr("query_id", "text AS q"), "query_id").join(docs.selectExpr("doc_id", "text AS d"), "doc_id")
    kinds = dict(texts.dtypes)
    return texts.mapInPandas(run, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double")
