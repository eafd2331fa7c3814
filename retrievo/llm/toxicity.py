"""Operator 2: toxicity by a learned lexicon, matched through Levenshtein automata.

Learning uses a bounded sample of labelled rows (``sample`` rows expected, chosen by a hash; of texts
that share a minimum hash of their word triples, copies mostly, one counts) without held-out rows.

1. Terms: words, and stems that many words share, whose presence depends on the label by a
   likelihood-ratio test are taken, the strongest first; a term is left out if one that is its
   prefix, or whose prefix it is, is already there.
2. Matching: the terms form a trie.  The Levenshtein automaton (one edit from 5 letters, two from 9;
   stems take any ending but no edits) is intersected with it, and the intersection is determinised
   as words are read; transitions are kept.  Near spellings that the sample shows to be ordinary
   words of clean texts don't count.
3. Context: a window of words around each match tells mention from use.  A match inside quotation
   marks or near a word of reporting counts a quarter, one near a direct address a quarter more.
4. Score: logistic regression on the sum, density and strength of the matches of a text.
   Regularisation pulls towards weights that make mentioned matches harmless.

Defined cases: null, empty and blank texts have no match and get the score of a text without any;
without training rows the lexicon is empty and all scores are 0.25; repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrievo.llm.storage import materialize

# Quotation marks, words of reporting, direct address, and look-alikes of letters.
OPENING, CLOSING = "\"'“‘«„‹`", "\"'”’»“›`"
REPORTING = {"said", "says", "wrote", "writes", "called", "calls", "word", "words", "term", "quote", "quoted", "quotes", "insult", "insults", "slur", "slurs", "translation", "means", "meaning", "definition", "reported", "alleged", "testified", "accused"}
ADDRESS = {"you", "your", "youre", "yourself", "ur", "u", "du", "dich", "tu", "toi", "vous", "usted"}
LOOKALIKES = str.maketrans("013457@$!|€", "oieastasiie")

LETTERS = re.compile(r"[^\W_]+")
PARTS = re.compile(r"[^\W_@$!|€]*[^\W_](?:[@$!|€*.\-']*[^\W_])*|[@$!|€][^\W_@$!|€]+")
RUN = re.compile(r"(.)\1{2,}")
WINDOW = 6
CACHE = 200_000


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 or term.endswith("*") else 1 if len(term) < 9 else 2


class Automaton:
    """The intersection of the terms' trie with their Levenshtein automata, determinised as it is used.

    A term that ends with ``*`` is a stem.  A state is the set of (trie node, edits so far) that some way of reading the word can have reached.
    """

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: dict[int, str] = {}
        self.budget = [0]  # the most edits that a term below the node allows
        self.stem: dict[int, str] = {}
        for term in terms:
            node, allowed = 0, edits_allowed(term)
            self.budget[0] = max(self.budget[0], allowed)
            for c in term.removesuffix("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.budget.append(0)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], allowed)
            (self.stem if term.endswith("*") else self.term)[node] = term
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.stems: list[str | None] = []
        self.ids: dict[tuple, int] = {}
        self.moves: list[dict[str, int]] = []
        self.start = self.state({0: 0})

    def state(self, reached: dict[int, int]) -> int:
        """The number of a state, after skipping letters of terms as far as edits allow."""
        todo = list(reached)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                e = reached[node] + 1
                if e <= self.budget[child] and e < reached.get(child, 99):
                    reached[child] = e
                    todo.append(child)
        key = tuple(sorted(reached.items()))
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            ends = [(e, self.term[n]) for n, e in key if n in self.term and e <= edits_allowed(self.term[n])]
            self.accepts.append(min(ends)[::-1] if ends else None)
            self.stems.append(next((self.stem[n] for n, e in key if n in self.stem and not e), None))
        return self.ids[key]

    def step(self, state: int, c: str) -> int:
        reached: dict[int, int] = {}
        for node, e in self.states[state]:
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.budget[child] and cost < reached.get(child, 99):
                    reached[child] = cost
            if e + 1 <= self.budget[node] and e + 1 < reached.get(node, 99):
                reached[node] = e + 1
        return self.state(reached) if reached else -1

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its edits, and the number of edits."""
        if len(self.states) > 50_000:
            self.reset()
        state, stem = self.start, None
        for c in word:
            nxt = self.moves[state].get(c)
            if nxt is None:
                nxt = self.moves[state][c] = self.step(state, c)
            if nxt < 0:
                return stem
            state = nxt
            if self.stems[state]:
                stem = self.stems[state], 0
        end = self.accepts[state]
        return stem if stem and (end is None or end[1]) else end


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    ordinary: frozenset[str] = frozenset()
    coefficients: tuple[float, ...] = ()
    prior: float = 0.25


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.automaton = Automaton(sorted(model.weights))
        self.cache: dict[str, tuple | None] = {}

    def spellings(self, token: str) -> Iterator[str]:
        low = token.lower()
        for part in LETTERS.findall(low):
            yield part
        for part in PARTS.findall(low):
            plain = "".join(LETTERS.findall(part.translate(LOOKALIKES)))
            yield plain
            yield RUN.sub(r"\1", plain)

    def look(self, token: str) -> tuple[str, int, str] | None:
        """(term, edits, spelling) of the best match in a token between white space."""
        best = None
        for spelling in dict.fromkeys(self.spellings(token)):
            found = self.automaton.match(spelling) if len(spelling) <= 64 else None
            if found and (not found[1] or spelling not in self.model.ordinary) and (best is None or found[1] < best[1]):
                best = (*found, spelling)
        return best

    def found(self, tokens: list[str]) -> list[tuple[int, tuple[str, int, str]]]:
        out, cache = [], self.cache
        for i, token in enumerate(tokens):
            try:
                hit = cache[token]
            except KeyError:
                if len(cache) >= CACHE:
                    cache.clear()
                hit = self.look(token)
                if len(token) <= 64:
                    cache[token] = hit
            if hit:
                out.append((i, hit))
        return out

    def mention(self, tokens: list[str], at: int) -> bool:
        """Inside quotation marks, or beside a word of reporting."""
        before, after = tokens[max(0, at - WINDOW) : at + 1], tokens[at : at + WINDOW + 1]
        if any("".join(LETTERS.findall(t.lower())) in REPORTING for t in (*before[-4:-1], *after[1:3])):
            return True
        opened = next((j for j, t in enumerate(reversed(before)) if t[0] in OPENING), None)
        closed = next((j for j, t in enumerate(after) if t.rstrip(".,;:!?")[-1:] and t.rstrip(".,;:!?")[-1] in CLOSING), None)
        if opened is None or closed is None:
            return False
        return not any(t.rstrip(".,;:!?")[-1:] and t.rstrip(".,;:!?")[-1] in CLOSING for t in before[len(before) - 1 - opened : -1])

    def features(self, text: str | None) -> tuple[float, ...]:
        """Any match in use, their sum and density, the strongest, those only mentioned, near spellings, several terms."""
        tokens = (text or "").split()
        used = mentioned = near = strongest = 0.0
        terms = set()
        for at, (term, edits, _) in self.found(tokens):
            weight = self.model.weights[term] * (0.8**edits)
            if self.mention(tokens, at):
                mentioned += weight
                continue
            window = tokens[max(0, at - 3) : at] + tokens[at + 1 : at + 4]
            if any("".join(LETTERS.findall(t.lower())) in ADDRESS for t in window):
                weight *= 1.25
            used += weight
            near += weight * (edits > 0)
            strongest = max(strongest, weight)
            terms.add(term)
        density = math.log(100 * used / (len(tokens) + 10)) if used else 0.0
        return float(used > 0), math.log1p(used), density, strongest, math.log1p(mentioned / 4), math.log1p(near), float(len(terms) > 1)

    def score(self, text: str | None) -> float:
        c = self.model.coefficients
        if not c:
            return self.model.prior
        z = c[0] + sum(a * b for a, b in zip(c[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


N_FEATURES = 7
#: Where regularisation pulls the coefficients: matches in use count, mentions and near spellings don't by themselves.
CENTRE = np.array([0.0, 2.0, 1.0, 0.5, 1.0, 0.0, 0.0, 0.5])


def regression(x: np.ndarray, y: np.ndarray, strength: float = 3.0, rounds: int = 50) -> tuple[float, ...]:
    """Ridge logistic regression around CENTRE by Newton's method; the intercept is free."""
    a = np.hstack((np.ones((len(x), 1)), x))
    w, ridge = CENTRE.copy(), np.full(a.shape[1], strength)
    ridge[0] = 1e-3
    w[0] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + ridge * (w - CENTRE)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w))


def unrelated(terms: list[str], most: int) -> list[str]:
    """Of terms, best first, those that aren't the beginning or a continuation of a better one."""
    chosen: list[str] = []
    for term in terms:
        plain = term.removesuffix("*")
        if len(chosen) < most and not any(plain.startswith(c.removesuffix("*")) or c.startswith(plain) for c in chosen):
            chosen.append(term)
    return chosen


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0, F.lit(False))


def _triple_hashes(text: str, seeds: int = 4) -> list[int]:
    """For each seed, the least hash of the text's word triples."""
    words = text.split()
    triples = {" ".join(words[i : i + 3]).encode() for i in range(max(1, len(words) - 2))}
    first = np.array([zlib.crc32(t) << 32 | zlib.adler32(t) for t in triples], dtype=np.uint64)
    out = []
    for seed in range(seeds):
        x = first * np.uint64(0x9E3779B97F4A7C15 + 2 * seed * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF)
        out.append(int((x ^ (x >> np.uint64(29))).min() >> np.uint64(1)))
    return out


def _terms(text: str) -> list[str]:
    """Distinct words of 3 to 32 letters, and stems of 4 to 8 letters."""
    words = {w for w in LETTERS.findall(text.lower()) if 3 <= len(w) <= 32}
    return [*words, *{f"{w[:n]}*" for w in words for n in range(4, min(len(w), 9))}]


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = 8_000, max_candidates: int = 2_000, max_terms: int = 300, significance: float = 30.0) -> Model:
    """Learn from labelled rows that aren't held out; ``sample`` bounds the expected number of rows."""
    wanted = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    wanted = wanted.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = wanted.count()
    if n > sample:
        wanted = wanted.filter(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) < int(sample / n * (1 << 30)))
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")  # about `sample` rows
    @F.pandas_udf("array<long>")
    def triples(texts: pd.Series) -> pd.Series:
        return texts.map(_triple_hashes)

    @F.pandas_udf("array<string>")
    def terms_of(texts: pd.Series) -> pd.Series:
        return texts.map(_terms)

    rows = materialize(rows.filter("text is not null").select("toxic", "text", triples("text").alias("triples")), "toxicity-rows")
    for i in range(4):  # near copies would pass for evidence about every word they share
        rows = rows.groupBy(F.col("triples")[i]).agg(F.min_by(F.struct("toxic", "text", "triples"), "triples").alias("r")).select("r.*")
    rows = materialize(rows.select("toxic", "text"), "toxicity-sample")
    total = {bool(r["toxic"]): r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = total.get(True, 0), total.get(False, 0)
    if not toxic or not clean:
        return Model(prior=(toxic + 0.5) / (toxic + clean + 2))
    terms = rows.select("toxic", F.explode(terms_of("text")).alias("term"))
    counts = terms.groupBy("term").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")).filter(F.col("p") >= 3)
    part = lambda k, whole: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) * (toxic + clean) / ((F.col("p") + F.col("n")) * whole))).otherwise(0.0)
    odds = F.log((F.col("p") + 0.5) / (toxic + 1)) - F.log((F.col("n") + 0.5) / (clean + 1))
    counts = counts.withColumn("odds", odds).withColumn("g2", F.round(2 * (part("p", toxic) + part("n", clean)), 6)).filter(f"odds > 1 and g2 >= {significance}")
    best = counts.orderBy(F.desc("g2"), F.col("term").endswith("*"), F.desc(F.length("term")), "term").limit(max_candidates).collect()
    if not best:
        return Model(prior=(toxic + 0.5) / (toxic + clean + 2))
    weight = {r["term"]: r["odds"] / 5 for r in best}
    model = Model(weights={t: weight[t] for t in unrelated(list(weight), max_terms)})

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for pdf in batches:
            out = [(hit[2], y) for text, y in zip(pdf["text"], pdf["toxic"], strict=True) for _, hit in scorer.found((text or "").split()) if hit[1]]
            yield pd.DataFrame(out, columns=["spelling", "toxic"])

    # of the near spellings, those that clean texts use like any other word
    seen = rows.select("text", "toxic").mapInPandas(near, "spelling string, toxic int").groupBy("spelling")
    seen = seen.agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")).filter(F.col("n") > F.col("p") * (0.5 * clean / toxic))
    model.ordinary = frozenset(r["spelling"] for r in seen.orderBy(F.desc("n"), "spelling").limit(100_000).collect())

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for pdf in batches:
            x = [scorer.features(t) for t in pdf["text"]]
            yield pd.DataFrame(x, columns=[f"x{i}" for i in range(N_FEATURES)]).assign(toxic=pdf["toxic"].to_numpy())

    schema = ", ".join(f"x{i} double" for i in range(N_FEATURES)) + ", toxic int"
    data = rows.select("text", "toxic").mapInPandas(gather, schema).toPandas()  # numbers of about `sample` rows
    model.coefficients = regression(data[[f"x{i}" for i in range(N_FEATURES)]].to_numpy(), data["toxic"].to_numpy(dtype=float))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            yield texts.map(scorer.score)

    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, unchanged."""
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for texts in batches:
            yield texts.map(lambda t: scorer.score(t) < 0.5)

    return docs.filter(clean("text"))
