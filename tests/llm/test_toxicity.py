"""Operator 2: the automaton against brute force, held-out accuracy, and defined cases."""

import random
import zlib

from retrievo.llm import queries, storage, toxicity
from tests.llm.cases import frame


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_is_the_edit_distance():
    terms = ["scum", "idiot", "moron", "worthless", "disgusting", "idiom"]
    automaton, rng = toxicity.Automaton(terms), random.Random(5)
    for _ in range(4000):
        word = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(word) + 1)
            word[at : at + rng.randrange(2)] = rng.choice(["", "x", "i", "t", "o"])
        word = "".join(word)
        near = [(distance(word, t), t) for t in terms if distance(word, t) <= toxicity.edits_allowed(t)]
        assert automaton.match(word) == (min(near)[::-1] if near else None), word


def test_stems_take_any_ending():
    automaton = toxicity.Automaton(["grump*", "idiot"])
    assert automaton.match("grumpily") == ("grump*", 0) and automaton.match("grumpy") == ("grump*", 0)
    assert automaton.match("grum") is None and automaton.match("idiots") == ("idiot", 1)


MODEL = toxicity.Model(weights={"idiot": 1.4, "worthless": 1.4, "scum": 1.4}, coefficients=(-4.0, 2.0, 1.0, 0.5, 1.0, 0.0, 0.0, 0.5))


def test_spelling_and_context():
    scorer = toxicity.Scorer(MODEL)
    plain = scorer.score("nothing to see in this text")
    for abuse in ("you are an idiot", "you 1diot", "what an idi0t, scum", "worthles idiooooot", "W0RTHLESS"):
        assert scorer.score(abuse) > 0.5 > plain, abuse
    for mention in ('the sign read "idiot" in red', "the word idiot is a noun", "she reported the insult idiot to them"):
        assert scorer.score(mention) < 0.5, mention
    assert scorer.score(None) == scorer.score("") == scorer.score(" \n ") == plain


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    rows = queries.queries()["op2_toxicity"](spark, folder).collect()
    labels = {r["doc_id"]: r["toxic"] for r in storage.table(spark, folder, "labels").collect()}
    assert len(rows) == storage.table(spark, folder, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    pairs = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in pairs) >= 0.97 * len(pairs)
    assert sum(b for a, b in pairs if a) >= 0.85 * sum(a for a, _ in pairs)


def test_defined_cases(spark):
    docs = frame(spark)
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, no_labels)).collect()
    assert len(rows) == docs.count() and {r["score"] for r in rows} == {0.25}
    assert toxicity.score(frame(spark, []), MODEL).count() == 0
    rows = toxicity.score(docs, MODEL).collect()
    assert len({r["score"] for r in rows}) == 1 and all(r["predicted"] == 0 for r in rows)
    kept = toxicity.accept(docs, MODEL)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    labels = spark.createDataFrame([(1, 1, 1), (2, None, None), (None, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == docs.count()
