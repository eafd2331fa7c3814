"""Operator 12: near duplicates by SuperMinHash signatures, bands and verification on full sets.

Sets are the distinct word n-grams of a text as 64-bit hashes; equal sets are one class.

Every element ranks the ``bands * depth`` slots of a signature by a random permutation of its own: in
step j it offers the value j + u, with u uniform in [0, 1), to the slot in its j-th place, and each slot
keeps the least value offered.  So the values of one element are correlated, the slots of a signature
vary less than independent minima do, and most sets need few steps: a set stops before step j once all
of its slots hold values below j, since later offers are greater.  Steps are taken for many sets at a
time, and only the elements of sets that haven't stopped keep a permutation.

``depth`` slots make a band, and classes meet where a band agrees.  With 25 bands of 4 slots, two sets
of similarity s never meet with probability (1 - s^4)^25: 2 in a million at 0.8, 10^-12 at 0.9.  The
parts that follow are those of the n-gram join: a bucket is never expanded into its pairs; every class is
verified against one centre, links make components, and buckets are searched for a spanning forest of
what size and parity sketch don't rule out.  For the buckets that still hold several components the full
sets travel with the rows, and the rows of different components are compared there, so that only links
are written, a forest of them; pairs with a set of over LONG elements are verified by their texts
instead.  All links are confirmed on the full sets.  Groups are found by alternating large-star and small-star steps over tables of links, the forests
inside a task by union-find.

Defined cases: null or blank text has an empty set, linked with nothing; fewer words than n make one
n-gram of all words; repeated rows are copies; rows without doc_id take part and link others, and a
component of such rows only has a null id (and keeps them); of rows that share a doc_id each has its
own set; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrievo.llm import jaccard
from retrievo.llm.jaccard import Bands, class_of, components, fine_parities, forest, parities, verified
from retrievo.llm.storage import materialize
from retrievo.llm.words import U, gram_sets, mixed

STEP = U(0x9E3779B97F4A7C15)
#: Elements that take their steps together.
TOGETHER = 1 << 15


def _offers(elements: np.ndarray, j: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each element in step j: the place (j or later) that is swapped to j, and the value it offers."""
    with np.errstate(over="ignore"):
        u = mixed(elements + U(j + 1) * STEP)
    place = ((u & U(0xFFFFFFFF)) * U(slots - j)) >> U(32)
    return place.astype(np.int64) + j, (U(j) << U(32)) | (u >> U(32))


def _together(elements: np.ndarray, owner: np.ndarray, sets: int, slots: int) -> np.ndarray:
    """Signatures (sets, slots) of the sets that ``owner`` (ascending) gives the elements to."""
    least = np.full(sets * slots, np.iinfo(np.uint64).max, dtype=U)
    place, value = _offers(elements, 0, slots)
    np.minimum.at(least, owner * slots + place, value)
    order = None
    for j in range(1, slots):
        going = least.reshape(sets, slots).max(axis=1) >= U(j) << U(32)
        stays = going[owner]
        if not stays.any():
            break
        elements, owner = elements[stays], owner[stays]
        if order is None:  # the permutations after step 0
            order = np.tile(np.arange(slots, dtype=np.uint16), (len(elements), 1))
            order[np.arange(len(elements)), place[stays]] = 0
        else:
            order = order[stays]
        row = np.arange(len(elements))
        place, value = _offers(elements, j, slots)
        slot = order[row, place].astype(np.int64)
        order[row, place] = order[:, j]
        np.minimum.at(least, owner * slots + slot, value)
    return least.reshape(sets, slots)


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """The signature of each set of 64-bit hashes; the values of an empty set are all ones."""
    out = np.full((len(sets), slots), np.iinfo(np.uint64).max, dtype=U)
    part: list[int] = []
    size = 0

    def flush():
        lengths = [len(sets[i]) for i in part]
        out[part] = _together(np.concatenate([sets[i] for i in part]), np.repeat(np.arange(len(part)), lengths), len(part), slots)

    for i, elements in enumerate(sets):
        if len(elements) > TOGETHER:  # the least of the signatures of its parts
            for k in range(0, len(elements), TOGETHER):
                some = elements[k : k + TOGETHER]
                out[i] = np.minimum(out[i], _together(some, np.zeros(len(some), dtype=np.int64), 1, slots)[0])
        elif len(elements):
            if part and size + len(elements) > TOGETHER:
                flush()
                part, size = [], 0
            part.append(i)
            size += len(elements)
    if part:
        flush()
    return out


def band_keys(signs: np.ndarray, depth: int) -> np.ndarray:
    """A 64-bit key of each band of ``depth`` slots of each signature; bands have different keys."""
    bands = signs.shape[1] // depth
    keys = np.tile(mixed(np.arange(1, bands + 1, dtype=U) * STEP), (len(signs), 1))
    for d in range(depth):
        keys = mixed(keys + signs[:, d : bands * depth : depth])
    return keys.view(np.int64)


def sets(docs: DataFrame, n: int, percent: int, bands: int, depth: int) -> DataFrame:
    """doc_id, text_key, cls, n_shingles, sketches and band keys of every row; a task gives these of a class once, empty after that."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes, done = Bands(percent), set()
        for pdf in batches:
            grams = gram_sets(pdf["text"].tolist(), n)
            names = [class_of(g) for g in grams]
            new = []
            for i, cls in enumerate(names):
                if cls is not None and cls not in done:
                    done.add(cls)
                    new.append(i)
            sketch, fine, keys = ([None] * len(pdf) for _ in range(3))
            for i, row in zip(new, band_keys(signatures([grams[i] for i in new], bands * depth), depth), strict=True):
                sketch[i], fine[i], keys[i] = parities(grams[i], sizes.bits(sizes.band(len(grams[i])))), fine_parities(grams[i]), row
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "text_key": pdf["text_key"], "cls": pd.array(names, dtype="Int64"), "n_shingles": [len(g) for g in grams],
                "sketch": sketch, "fine": fine, "bands": keys,
            })

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInPandas(run, "doc_id long, text_key long, cls long, n_shingles long, sketch binary, fine binary, bands array<long>")


#: Elements of a set up to which it travels with the rows of buckets, and rows of a bucket that meet with their sets at a time.
LONG, BLOCK_ROWS = 8192, 1024
#: Elements of a part that are told apart at a time.
SLICE = 1 << 16


class Part:
    """Rows of a part of a bucket with their full sets; null for those that are too long."""

    def __init__(self, pdf: pd.DataFrame):
        self.cls, self.comp, self.size = (pdf[c].to_numpy() for c in ("cls", "comp", "n_shingles"))
        self.sets = [np.frombuffer(x, dtype=U) if x is not None else None for x in pdf["grams"]]
        self.long = np.array([x is None for x in self.sets], dtype=bool)


def shared_elements(x: Part, i: np.ndarray, y: Part, j: np.ndarray) -> np.ndarray:
    """The size of the intersection of the sets of rows i and rows j, by bits of the elements that several rows have."""
    both = [*x.sets, *y.sets] if x is not y else x.sets
    elements, inverse, counts = np.unique(np.concatenate([s for s in both if s is not None]), return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    cell, owner = number[inverse], np.repeat(np.arange(len(both)), [0 if s is None else len(s) for s in both])
    keep = counts[inverse] > 1
    cell, owner, wide = cell[keep], owner[keep], int((counts > 1).sum())
    to = j + (0 if x is y else len(x.sets))
    out = np.zeros(len(i), dtype=np.int64)
    for at in range(0, wide, SLICE):
        some = (cell >= at) & (cell < at + SLICE)
        flags = np.zeros((len(both), -(-min(SLICE, wide - at) // 64) * 64), dtype=bool)
        flags[owner[some], cell[some] - at] = True
        bits = np.packbits(flags, axis=1).view(U)
        step = max(1, (1 << 20) // bits.shape[1])
        for k in range(0, len(i), step):
            out[k : k + step] += np.bitwise_count(bits[i[k : k + step]] & bits[to[k : k + step]]).sum(axis=1, dtype=np.int64)
    return out


def _compared(x: Part, y: Part, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, certain): rows of different components that link, or, uncertain, that have to be verified by their texts."""
    size = x.size[:, None]
    meet = (x.comp[:, None] != y.comp) & (100 * np.minimum(size, y.size) >= percent * np.maximum(size, y.size))
    if x is y:
        meet = np.triu(meet, 1)
    i, j = np.nonzero(meet)
    certain = ~(x.long[i] | y.long[j])
    both = shared_elements(x, i[certain], y, j[certain]) if certain.any() else np.zeros(0, dtype=np.int64)
    keep = np.ones(len(i), dtype=bool)
    keep[certain] = 100 * both >= percent * (x.size[i[certain]] + y.size[j[certain]] - both)
    return i[keep], j[keep], certain[keep]


def _links(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, certain) of rows sorted by sig, part and guest: links of different components, a forest in each task, and pairs with long sets."""
    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[Part, Part]]:
        """Own rows of a part (some BLOCK_ROWS, held) with themselves and with blocks of its guests, which pass by."""
        held, key, own = [], None, None
        for pdf in batches:
            names = pdf[["sig", "part"]].to_numpy()
            guest = pdf["guest"].to_numpy()
            turns = np.flatnonzero((names[1:] != names[:-1]).any(axis=1) | (guest[1:] != guest[:-1])) + 1
            for at, end in zip([0, *turns], [*turns, len(pdf)], strict=True):
                if end == at:
                    continue
                if tuple(names[at]) != key:
                    if held:
                        own = Part(pd.concat(held))
                        yield own, own
                    held, own, key = [], None, tuple(names[at])
                if not guest[at]:
                    held.append(pdf.iloc[at:end])
                    continue
                if held:
                    own, held = Part(pd.concat(held)), []
                    yield own, own
                if own is not None:
                    for k in range(at, end, 256):
                        yield Part(pdf.iloc[k : min(k + 256, end)]), own
        if held:
            own = Part(pd.concat(held))
            yield own, own

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, pool, size = ["u", "v", "a", "b"], [np.zeros((0, 4), dtype=np.int64)], 0
        reduced = lambda: (edges := np.concatenate(pool))[forest(edges[:, 0], edges[:, 1], np.zeros(len(edges), dtype=np.int64))]
        for x, y in parts(batches):
            if len(x.cls) + len(y.cls) < 2 or (x.comp == x.comp[0]).all() and (y.comp == x.comp[0]).all():
                continue
            i, j, certain = _compared(x, y, percent)
            edges = np.column_stack((x.comp[i], y.comp[j], x.cls[i], y.cls[j]))
            if not certain.all():
                yield pd.DataFrame({"a": edges[~certain, 2:].min(axis=1), "b": edges[~certain, 2:].max(axis=1), "certain": False})
            pool.append(edges[certain])
            size += int(certain.sum())
            if size > jaccard.POOL_ROWS:
                pool = [reduced()]
                size = 0
                if len(pool[0]) > jaccard.POOL_ROWS:
                    yield pd.DataFrame({"a": pool[0][:, 2:].min(axis=1), "b": pool[0][:, 2:].max(axis=1), "certain": True})
                    pool = [pool[0][:0]]
        found = reduced()
        yield pd.DataFrame({"a": found[:, 2:].min(axis=1), "b": found[:, 2:].max(axis=1), "certain": True})

    return rows.mapInPandas(run, "a long, b long, certain boolean").distinct()


def _open_with_sets(shared: DataFrame, found: DataFrame, owners: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """Rows of buckets with several components and their sets, dealt by bucket and part; guests are copies of rows of other parts."""
    labelled = shared.select("sig", "cls").join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")
    labelled = materialize(labelled, "minhash-labelled")
    buckets = labelled.groupBy("sig").agg(F.count(F.lit(1)).alias("rows"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    buckets = materialize(buckets.filter("low <> high").select("sig", "rows"), "minhash-open")
    rows = labelled.join(buckets, "sig")
    common = rows.filter(F.col("rows") > BLOCK_ROWS).groupBy("sig", "comp").count().groupBy("sig").agg(F.max_by("comp", F.struct("count", "comp")).alias("common"))
    parts = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
    large = jaccard._by_key(rows.filter(F.col("rows") > BLOCK_ROWS), common, "sig").withColumn("home", F.pmod(F.xxhash64("cls"), parts).cast("int"))
    to = F.when(F.col("comp") == F.col("common"), F.array("home")).otherwise(F.sequence(F.lit(0), parts - 1))
    large = large.withColumn("part", F.explode(to)).select("sig", "cls", "comp", "part", (F.col("part") != F.col("home")).alias("guest"))
    small = rows.filter(F.col("rows") <= BLOCK_ROWS).select("sig", "cls", "comp", F.lit(0).alias("part"), F.lit(False).alias("guest"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            grams = gram_sets(pdf["text"].tolist(), n)
            yield pd.DataFrame({"cls": pdf["cls"], "n_shingles": [len(g) for g in grams], "grams": [g.tobytes() if len(g) <= LONG else None for g in grams]})

    wanted = rows.select("cls").distinct().join(owners.select("cls", F.col("doc_id").alias("id"), F.col("text_key").alias("key")), "cls")
    wanted = materialize(wanted, "minhash-wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= jaccard.BROADCAST_ROWS else wanted
    texts = docs.select("doc_id", "text").join(wanted, (F.xxhash64("text") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("cls", "text")
    grams = materialize(texts.dropDuplicates(["cls"]).mapInPandas(hashed, "cls long, n_shingles long, grams binary"), "minhash-grams")
    return small.unionByName(large).join(grams, "cls").repartition("sig", "part").sortWithinPartitions("sig", "part", "guest")


def near_duplicates(docs: DataFrame, *, n: int = 5, percent: int = 80, bands: int = 25, depth: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the least doc_id reachable by links) and kept (it is that id)."""
    rows = materialize(sets(docs, n, percent, bands, depth), "minhash-sets")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("least")
    some = lambda c: F.first(c, ignorenulls=True).alias(c)
    owners = rows.filter("cls is not null").groupBy("cls").agg(least, F.min("n_shingles").alias("n_shingles"), some("sketch"), some("fine"), some("bands"))
    owners = materialize(owners.select("cls", "least.doc_id", "least.text_key", "n_shingles", "sketch", "fine", "bands"), "minhash-owners")

    index = owners.select("cls", F.explode("bands").alias("sig"))
    buckets = index.groupBy("sig").agg(F.count(F.lit(1)).alias("rows"), F.min("cls").alias("center"))
    shared = materialize(index.join(buckets.filter("rows > 1").select("sig", "center"), "sig"), "minhash-shared")
    votes = shared.filter("center <> cls").groupBy("cls", "center").agg(F.count(F.lit(1)).alias("votes"))
    best = F.max_by("center", F.struct("votes", -F.col("center").cast("decimal(20,0)")))
    pairs = materialize(votes.groupBy("cls").agg(best.alias("b")).select(F.col("cls").alias("a"), "b"), "minhash-first")

    # every row of a bucket may link every other one
    shared = shared.select("sig", "cls", F.lit(0).alias("kind"), F.lit(True).alias("use"), F.lit(False).alias("near"))
    known = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = verified(pairs, docs, owners, n, percent)
    found = materialize(components(links), "minhash-components-first")
    pairs = jaccard._spanning(jaccard._open_rows(shared, found, owners), percent)
    pairs = materialize(pairs.join(known, ["a", "b"], "left_anti"), "minhash-spanning")
    links = links.union(verified(pairs, docs, owners, n, percent))
    found = materialize(components(links), "minhash-components-spanning")
    rest = materialize(_links(_open_with_sets(shared, found, owners, docs, n), percent), "minhash-rest")
    links = links.union(rest.filter("certain").select("a", "b"))
    if not rest.filter("not certain").isEmpty():
        links = links.union(verified(rest.filter("not certain").select("a", "b"), docs, owners, n, percent))
    found = materialize(components(links), "minhash-components")
    classes = owners.select("cls", "doc_id").join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    names = classes.select("cls", "component").join(least, "component").select("cls", "component_id")
    out = rows.select("doc_id", "cls", "n_shingles").join(names, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


#: ``near_duplicates`` of word pairs, by comparing all documents that share one: for small tables.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS grams FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT s.doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.least_id, s.doc_id)) AS component_id
  FROM s LEFT JOIN (SELECT a, min(b) AS least_id FROM reach GROUP BY a) m ON m.a = s.doc_id)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM c
"""
