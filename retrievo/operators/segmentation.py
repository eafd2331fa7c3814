"""Words of text without spaces: the path of greatest probability over a lattice of known words.

The lexicon is learned from a corpus: counts of its words, or of all character runs where words aren't
marked.  A run of text meets the words that it may hold by a join on its substrings, so each run brings
its own part of the lexicon and the whole is never sent to a task.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Log probability of a character that no word of the lexicon covers, beside the logarithm of the corpus's size.
UNKNOWN = 4.0


def substrings(run: Column, longest: int) -> Column:
    """All distinct substrings of up to ``longest`` characters."""
    starts = F.sequence(F.lit(1), F.length(run))
    lengths = F.sequence(F.lit(1), F.lit(longest))
    each = F.transform(starts, lambda i: F.transform(F.filter(lengths, lambda n: i + n - 1 <= F.length(run)), lambda n: F.substring(run, i, n)))
    return F.when(F.length(run) > 0, F.array_distinct(F.flatten(each))).otherwise(F.array().cast("array<string>"))


def learned(words: DataFrame, longest: int = 12, least: int = 1) -> DataFrame:
    """word, score (log probability) of ``words(word)`` that occur ``least`` times and have up to ``longest`` characters."""
    counts = words.filter(F.length("word").between(1, longest)).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("word", F.log(F.col("n") / F.col("total")).alias("score"))  # one row


def run_words(runs: DataFrame, longest: int = 4) -> DataFrame:
    """``words(word)`` of runs where words aren't marked: every substring, as often as it occurs."""
    lengths = F.sequence(F.lit(1), F.lit(longest))
    each = F.transform(F.sequence(F.lit(1), F.length("run")), lambda i: F.transform(F.filter(lengths, lambda n: i + n - 1 <= F.length("run")), lambda n: F.substring("run", i, n)))
    return runs.filter(F.length("run") > 0).select(F.explode(F.flatten(each)).alias("word"))


def best_path(run: str, scores: dict[str, float], floor: float, longest: int) -> list[str]:
    """The words of greatest summed score; of equal ones the path whose first differing word is longer.

    A character that is no word scores ``floor``.
    """
    n = len(run)
    best, step = [0.0] * (n + 1), [0] * (n + 1)
    for at in range(n - 1, -1, -1):
        best[at] = -math.inf
        for length in range(min(longest, n - at), 0, -1):
            score = scores.get(run[at : at + length], floor if length == 1 else None)
            if score is not None and score + best[at + length] > best[at]:
                best[at], step[at] = score + best[at + length], length
    out, at = [], 0
    while at < n:
        out.append(run[at : at + step[at]])
        at += step[at]
    return out


def segmented(runs: DataFrame, lexicon: DataFrame, longest: int = 12) -> DataFrame:
    """run, words of the distinct ``runs(run)``; each run meets the lexicon by its substrings."""
    distinct = runs.select("run").filter("run is not null").distinct()
    floor = lexicon.agg((F.coalesce(F.min("score"), F.lit(0.0)) - UNKNOWN).alias("floor"))
    held = distinct.select("run", F.explode(substrings(F.col("run"), longest)).alias("word")).join(lexicon, "word")
    held = held.groupBy("run").agg(F.collect_list(F.struct("word", "score")).alias("known"))
    rows = distinct.join(held, "run", "left").join(F.broadcast(floor))  # one row

    @F.pandas_udf("array<string>")
    def path(run: pd.Series, known: pd.Series, floor: pd.Series) -> pd.Series:
        return pd.Series([best_path(r, {} if k is None else {x["word"]: x["score"] for x in k}, f, longest) for r, k, f in zip(run, known, floor, strict=True)])

    return rows.select("run", path("run", "known", "floor").alias("words"))
