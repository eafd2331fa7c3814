"""Operator 7: exact Jaccard join of word n-grams by universe partition and pigeonhole.

Sets are the distinct word n-grams of a text as 64-bit hashes; equal sets are one class.

Two sets of x <= y elements with Jaccard similarity of at least s differ in at most
``floor((1 - s) / (1 + s) * (x + y))`` elements, H.  Sizes are cut into bands so that a set links to
its own band and the next only.  For a band the universe of elements is hashed into m > H segments;
sets that link agree exactly on one of any H + 1 segments, or, counting a segment twice, differ there
by one element at most.  Each set writes the signatures of its m segment subsets, for its own band
and as the larger set for the band below, and for segment 0 those of the one-deletion neighbourhood.

Costs decide which segments a set relies on: signatures shared by more than ``hot`` sets are left out,
the most frequent first, as long as the remaining segments, with segment 0 counted twice through its
neighbourhood, still make H + 1.  Frequencies are exact and cover all rows.

A bucket of a signature is never expanded into its pairs.  First every class is verified against one
centre, the least class of a bucket it shares most often; links join classes to components, of which
large groups of copies become one.  Then each task takes the pairs of its buckets that lie in
different components and that size and sketch don't rule out, and writes a spanning forest of them
over the components, the least different pairs first: fewer pairs than it has components.  What is
still in different components after these are verified is verified whole.  So only the last round
writes more than a pair for each row, and only pairs close to the threshold.  No link between
different components is lost, and the result is exact.  A parity sketch has a bit for each cell of
the hashed universe; sets differ by at least as many elements as their sketches by bits.

A bucket of more than ``BLOCK_ROWS`` rows is cut into parts.  Rows of its most common component are in
one part each, only the others meet all parts.

Components are found by alternating large-star and small-star steps over tables of links.

Defined cases: null or blank text has an empty set, linked with nothing; fewer words than n make one
n-gram of all words; repeated rows are copies; rows without doc_id take part and link others, and a
component of such rows only has a null id; of rows that share a doc_id each has its own set; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrievo.llm.storage import materialize
from retrievo.llm.words import U, gram_sets, mixed

#: Rows of a lookup table (some 50 bytes each) that may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 2_000_000

#: Bits of a sketch in the rows of buckets; pairs of larger sets are also compared by finer sketches.
MOST_BITS = 2048


def class_of(grams: np.ndarray) -> int | None:
    """A signed 64-bit name of a set; equal sets, equal names."""
    if not len(grams):
        return None
    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes())).astype(np.int64))


class Bands:
    """Bands of set sizes, and for each the bound H, the segments m and the credit to leave segments out."""

    def __init__(self, percent: int):
        self.percent, self.lows = percent, [1]

    def band(self, size: int) -> int:
        while self.lows[-1] <= size:
            low = self.lows[-1]
            self.lows.append(max(low, low * 100 // self.percent) + 1)
        return int(np.searchsorted(self.lows, size, side="right")) - 1

    def bound(self, band: int) -> int:
        self.band(self.lows[-1] if band >= len(self.lows) - 1 else 1)
        while band >= len(self.lows) - 1:
            self.band(self.lows[-1])
        high = self.lows[band + 1] - 1
        return (100 - self.percent) * (high + high * 100 // self.percent) // (100 + self.percent)

    def spare(self, band: int) -> int:
        """Segments beyond H + 1."""
        return 1 + (self.bound(band) + 1) // 8

    def segments(self, band: int) -> int:
        return self.bound(band) + 1 + self.spare(band)

    def bits(self, band: int) -> int:
        """Of the sketch that travels with the rows of a bucket: one to two an element, up to MOST_BITS."""
        self.bound(band)
        return min(max(64, 1 << (self.lows[band + 1] - 2).bit_length()), MOST_BITS)


def signatures(grams: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, places): a place is band, segment and 1 for a one-deletion neighbour, packed."""
    own = bands.band(len(grams))
    sigs, places = [], []
    base = mixed(grams)
    low, high = (base & U(0xFFFFFFFF)).astype(np.float64), (base >> U(32)).astype(np.float64)  # sums stay exact below 2^53
    spot = mixed(grams + U(1)) >> U(32)
    for band in (own - 1, own):
        if band < 0 or bands.bound(band) < 1:  # sets that link are equal there
            continue
        m = bands.segments(band)
        segment = ((spot * U(m)) >> U(32)).astype(np.int64)
        total = np.bincount(segment, weights=low, minlength=m).astype(U) + (np.bincount(segment, weights=high, minlength=m).astype(U) << U(32))
        count = np.bincount(segment, minlength=m).astype(U)
        place = (U(band) << U(33)) + (np.arange(m, dtype=U) << U(1))
        sigs.append(mixed(total + mixed(place + (count << U(40)))))
        places.append(place)
        inside = np.flatnonzero(segment == 0)
        if len(inside):
            place = U(band) << U(33)
            sigs.append(mixed(total[0] - base[inside] + mixed(np.array([place + ((count[0] - U(1)) << U(40))], dtype=U))))
            places.append(np.full(len(inside), place + U(1), dtype=U))
    if not sigs:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(sigs).view(np.int64), np.concatenate(places).view(np.int64)


def parities(grams: np.ndarray, bits: int) -> bytes:
    """A bit for each of ``bits`` cells (a power of two, 64 at least): is the number of elements in it odd?"""
    cells = np.bincount((mixed(grams) & U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & np.uint8(1)
    return np.packbits(cells, bitorder="little").tobytes()


def fine_parities(grams: np.ndarray) -> bytes:
    """The same with four to eight bits an element."""
    return parities(grams, max(64, 1 << (4 * len(grams)).bit_length()))


def folded(sketches: np.ndarray) -> np.ndarray:
    """The sketches of half as many cells."""
    half = sketches.shape[-1] // 2
    return sketches[..., :half] ^ sketches[..., half:]


def least_difference(a: bytes, b: bytes) -> int:
    """What two sets differ by at least; the finer sketch is folded to the other's cells."""
    x, y = np.frombuffer(a, dtype=U), np.frombuffer(b, dtype=U)
    while len(x) > len(y):
        x = folded(x)
    while len(y) > len(x):
        y = folded(y)
    return int(np.bitwise_count(x ^ y).sum())


def sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, text_key, cls, n_shingles and the sketches of every row; doc_id and text_key tell texts apart."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands = Bands(percent)
        for pdf in batches:
            grams = gram_sets(pdf["text"].tolist(), n)
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "text_key": pdf["text_key"], "cls": pd.array([class_of(g) for g in grams], dtype="Int64"), "n_shingles": [len(g) for g in grams],
                "sketch": [parities(g, bands.bits(bands.band(max(1, len(g))))) for g in grams], "fine": [fine_parities(g) for g in grams],
            })

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInPandas(run, "doc_id long, text_key long, cls long, n_shingles long, sketch binary, fine binary")


def _index(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(sig, cls, place) of every class; a task writes a class once, later ones count equal rows once."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands, done = Bands(percent), set()
        for pdf in batches:
            sigs, places, owners, size = [], [], [], 0
            for grams in gram_sets(pdf["text"].tolist(), n):
                cls = class_of(grams)
                if cls is None or cls in done:
                    continue
                done.add(cls)
                s, p = signatures(grams, bands)
                sigs.append(s)
                places.append(p)
                owners.append(np.full(len(s), cls, dtype=np.int64))
                size += len(s)
                if size > 500_000:
                    yield pd.DataFrame({"sig": np.concatenate(sigs), "cls": np.concatenate(owners), "place": np.concatenate(places)})
                    sigs, places, owners, size = [], [], [], 0
            if size:
                yield pd.DataFrame({"sig": np.concatenate(sigs), "cls": np.concatenate(owners), "place": np.concatenate(places)})

    return docs.select("text").mapInPandas(run, "sig long, cls long, place long")


def _allocated(index: DataFrame, percent: int, hot: int) -> DataFrame:
    """Rows of signatures that several classes share: sig, cls, kind, use (relied on), near (by its neighbourhood)."""
    bucket = Window.partitionBy("sig")
    shared = index.withColumn("rows", F.count(F.lit(1)).over(bucket)).withColumn("other", F.min("cls").over(bucket) != F.max("cls").over(bucket))
    shared = materialize(shared.filter("other").select("sig", "cls", "place", "rows").distinct(), "jaccard-shared")
    bands = Bands(percent)
    last = bands.band(1 << 31)  # no text has more words
    credit = F.element_at(F.array(*[F.lit(bands.spare(b)) for b in range(last + 1)]), F.col("band").cast("int") + 1)
    rows = shared.select(
        "sig", "cls", "rows", F.shiftright("place", 33).alias("band"), (F.col("place") % 2).cast("int").alias("kind"),
        F.shiftright("place", 1).bitwiseAND((1 << 32) - 1).alias("segment"),
    )
    rows = rows.withColumn("costly", (F.col("kind") == 0) & (F.col("segment") != 0) & (F.col("rows") > hot))
    # the costliest segments of a class and band, as many as its credit and the neighbourhood allow
    first = Window.partitionBy("cls", "band").orderBy(F.desc("costly"), F.desc("rows"), "segment", "kind", "sig")
    rows = rows.withColumn("left_out", F.col("costly") & (F.row_number().over(first) <= credit + 1))
    near = F.sum(F.col("left_out").cast("int")).over(Window.partitionBy("cls", "band")) > credit
    return materialize(
        rows.withColumn("near", near).select(
            "sig", "cls", "kind", F.when(F.col("kind") == 0, ~F.col("left_out")).otherwise(F.col("near")).alias("use"),
            (F.col("near") & (F.col("segment") == 0)).alias("near"),
        ),
        "jaccard-rows",
    )


def _may_link(center: str) -> Column:
    """A row of any kind and an exact row (the columns with the prefix) of one bucket: does one of them rely on it?"""
    use, near = F.col(f"{center}use"), F.col(f"{center}near")
    return F.when(F.col("kind") == 0, use | F.col("use")).otherwise(near | F.col("use"))


#: Rows of a bucket that meet at a time, some 300 bytes each; rows that link with few others are copied to each block.
BLOCK_ROWS = 8192
#: Rows of a bucket up to which all buckets of a batch are compared at once.
SMALL_ROWS = 48


class Block:
    """Rows in the order of their buckets; what pairs of them may link."""

    COLUMNS = ("cls", "comp", "kind", "use", "near", "n_shingles")

    def __init__(self, pdf: pd.DataFrame, percent: int):
        self.cls, self.comp, self.kind, use, near, size = (pdf[c].to_numpy() for c in self.COLUMNS)
        self.use, self.near, self.size, self.percent = use.astype(bool), near.astype(bool), size.astype(np.int64), percent
        self.words = np.array([len(x) // 8 for x in pdf["sketch"]], dtype=np.int64)
        self.cells = np.zeros((len(pdf), max(self.words, default=1)), dtype=U)
        for w in np.unique(self.words):
            at = np.flatnonzero(self.words == w)
            self.cells[at, :w] = np.frombuffer(b"".join(pdf["sketch"].iloc[at]), dtype=U).reshape(-1, w)

    def at(self, i: np.ndarray, words: int) -> np.ndarray:
        """The sketches of some rows, folded to so many words."""
        wide = i[self.words[i] > words]
        out = self.cells[i, :words] if self.cells.shape[1] >= words else np.zeros((len(i), words), dtype=U)
        if len(wide):
            x = self.cells[wide, : 2 * words]
            out[self.words[i] > words] = folded(x)
        return out

    def links(self, i: np.ndarray, other: Block, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of the pairs of rows i and rows j of ``other`` that may link, and the least they differ by.

        Widths of two sets that may link differ by one doubling at most.
        """
        exact_i, exact_j = self.kind[i] == 0, other.kind[j] == 0
        use_i, use_j = self.use[i], other.use[j]
        keep = (exact_i & exact_j & (use_i | use_j)) | (exact_i & ~exact_j & (use_j | self.near[i])) | (~exact_i & exact_j & (use_i | other.near[j]))
        x, y = self.size[i], other.size[j]
        keep &= (self.comp[i] != other.comp[j]) & (100 * np.minimum(x, y) >= self.percent * np.maximum(x, y))
        i, j = i[keep], j[keep]
        both = self.size[i] + other.size[j]
        most = both - 2 * -(-self.percent * both // (100 + self.percent))
        least, width = np.zeros(len(i), dtype=np.int64), np.minimum(self.words[i], other.words[j])
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            for k in range(0, len(at), 1 << 15):
                part = at[k : k + (1 << 15)]
                least[part] = np.bitwise_count(self.at(i[part], w) ^ other.at(j[part], w)).sum(axis=1)
        keep = least <= most
        return i[keep], j[keep], least[keep]


def _met(rows: Iterator[pd.DataFrame], percent: int) -> Iterator[tuple[Block, np.ndarray, Block, np.ndarray, np.ndarray]]:
    """Pairs that may link, as (block, rows, block, rows, least difference), of rows sorted by sig, part and guest.

    The rows of a part are its own first, at most about BLOCK_ROWS, which are held; its guests pass by.
    """
    held: list[pd.DataFrame] = []
    held_key, own = None, None  # of the part that the last batch ended in

    def among(block: Block, first: int, last: int):
        """Pairs inside a large part: each row outside its most common component against all."""
        labels, counts = np.unique(block.comp[first:last], return_counts=True)
        outside = np.flatnonzero(block.comp[first:last] != labels[counts.argmax()]) + first
        every = np.arange(first, last)
        for k in range(0, len(outside), 64):
            some = outside[k : k + 64]
            i, j = np.repeat(some, len(every)), np.tile(every, len(some))
            yield block, *_in_order(block.links(i, block, j), block)

    def _in_order(found, block):
        i, j, least = found
        return i, block, j, least

    def against(guests: Block):
        every = np.arange(len(own.cls))
        for k in range(0, len(guests.cls), 64):
            some = np.arange(k, min(k + 64, len(guests.cls)))
            i, j, least = guests.links(np.repeat(some, len(every)), own, np.tile(every, len(some)))
            yield guests, i, own, j, least

    def parts(pdf: pd.DataFrame):
        """All pairs of the own rows of whole parts."""
        block = Block(pdf, percent)
        key = pdf[["sig", "part"]].to_numpy()
        edges = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(pdf)]))
        lengths = np.diff(edges)
        small = np.repeat(lengths <= SMALL_ROWS, lengths)
        left = np.repeat(edges[1:], lengths) - np.arange(len(pdf))  # rows to the end of the part, itself included
        for step in range(1, min(SMALL_ROWS, lengths.max(initial=0))):
            i = np.flatnonzero(small & (left > step))
            if len(i):
                yield block, *_in_order(block.links(i, block, i + step), block)
        for k in np.flatnonzero(lengths > SMALL_ROWS):
            yield from among(block, edges[k], edges[k + 1])

    for pdf in rows:
        at = 0
        guest, key = pdf["guest"].to_numpy(), pdf[["sig", "part"]].to_numpy()
        # runs of own rows and of guests
        same = (guest[1:] == guest[:-1]) & (~guest[1:] | (key[1:] == key[:-1]).all(axis=1))
        for end in [*(np.flatnonzero(~same) + 1), len(pdf)]:
            run, at = pdf.iloc[at:end], end
            if not len(run):
                continue
            if run["guest"].iloc[0]:
                if held:  # the guests' part is the last of those held
                    whole = pd.concat(held, ignore_index=True)
                    held = []
                    yield from parts(whole)
                    k = whole[["sig", "part"]].to_numpy()
                    held_key = tuple(k[-1])
                    own = Block(whole[(k == k[-1]).all(axis=1)], percent)
                if held_key == tuple(run[["sig", "part"]].to_numpy()[0]):  # else the part has no rows of its own
                    yield from against(Block(run, percent))
                continue
            held.append(run)
        if held:  # all parts but the last are whole
            whole = pd.concat(held, ignore_index=True)
            k = whole[["sig", "part"]].to_numpy()
            last = (k == k[-1]).all(axis=1)
            held = [whole[last]]
            if not last.all():
                yield from parts(whole[~last])
    if held:
        yield from parts(pd.concat(held, ignore_index=True))


def _open_rows(shared: DataFrame, found: DataFrame, owners: DataFrame) -> DataFrame:
    """Rows of buckets with several components, dealt by bucket and part; guests are copies of rows of other parts."""
    labelled = shared.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls")).drop("component")
    labelled = materialize(labelled, "jaccard-labelled")
    buckets = labelled.groupBy("sig").agg(F.count(F.lit(1)).alias("rows"), F.min("comp").alias("least"), F.max("comp").alias("most"))
    buckets = materialize(buckets.filter("least <> most").select("sig", "rows"), "jaccard-open")
    small = labelled.join(buckets.filter(F.col("rows") <= BLOCK_ROWS), "sig").withColumn("part", F.lit(0)).withColumn("guest", F.lit(False))
    large = _by_key(labelled, buckets.filter(F.col("rows") > BLOCK_ROWS), "sig")
    common = large.groupBy("sig", "comp").count().groupBy("sig").agg(F.max_by("comp", F.struct("count", "comp")).alias("common"))
    parts = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
    large = _by_key(large, common, "sig").withColumn("home", F.pmod(F.xxhash64("cls"), parts).cast("int"))
    to = F.when(F.col("comp") == F.col("common"), F.array("home")).otherwise(F.sequence(F.lit(0), parts - 1))
    large = large.withColumn("part", F.explode(to)).withColumn("guest", F.col("part") != F.col("home")).drop("common", "home")
    rows = small.unionByName(large).drop("rows").join(owners.select("cls", "n_shingles", "sketch"), "cls")
    return rows.repartition("sig", "part").sortWithinPartitions("sig", "part", "guest")


def forest(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The edges (x, y) of a least spanning forest, as positions (every tree's lightest edge to another tree, until none is left)."""
    names, ends = np.unique(np.concatenate((x, y)), return_inverse=True)
    order = np.lexsort((y, x, weight))
    x, y = ends[: len(x)][order], ends[len(x) :][order]
    root, chosen, left = np.arange(len(names)), [], np.arange(len(x))
    while True:
        left = left[root[x[left]] != root[y[left]]]
        if not len(left):
            return order[np.concatenate(chosen)] if chosen else order[:0]
        first = np.full(len(names), len(x))
        for end in (x, y):
            np.minimum.at(first, root[end[left]], left)
        edges = np.unique(first[first < len(x)])  # positions differ, so these make no circle
        chosen.append(edges)
        to = root.tolist()

        def find(i: int, to: list[int] = to) -> int:
            while to[i] != i:
                to[i] = to[to[i]]
                i = to[i]
            return i

        for i, j in zip(x[edges].tolist(), y[edges].tolist(), strict=True):
            to[find(i)] = find(j)
        root = np.array([find(i) for i in range(len(to))])


#: Pairs that a task gathers before it reduces them to a forest, and edges of a forest that it holds.
POOL_ROWS = 200_000


def _spanning(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes that span, in each task, the components whose classes may link; one for each two components."""
    def reduced(pool: list[np.ndarray]) -> np.ndarray:
        edges = np.concatenate(pool)
        return edges[forest(edges[:, 0], edges[:, 1], edges[:, 2])] if len(edges) else edges

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["u", "v", "least", "a", "b"]
        pool, size = [np.zeros((0, 5), dtype=np.int64)], 0
        for first, i, second, j, least in _met(batches, percent):
            if not len(i):
                continue
            u, v, x, y = first.comp[i], second.comp[j], first.cls[i], second.cls[j]
            pool.append(np.column_stack((np.minimum(u, v), np.maximum(u, v), least, np.minimum(x, y), np.maximum(x, y))))
            size += len(i)
            if size > POOL_ROWS:
                pool, size = [reduced(pool)], 0
                if len(pool[0]) > POOL_ROWS:
                    yield pd.DataFrame(pool[0], columns=names)
                    pool = [pool[0][:0]]
        yield pd.DataFrame(reduced(pool), columns=names)

    best = rows.mapInPandas(run, "u long, v long, least long, a long, b long").groupBy("u", "v").agg(F.min(F.struct("least", "a", "b")).alias("best"))
    return best.select("best.a", "best.b").distinct()


def _bucket_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of classes of different components that share a bucket and aren't ruled out by size or sketch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for first, i, second, j, _ in _met(batches, percent):
            if len(i):
                x, y = first.cls[i], second.cls[j]
                yield pd.DataFrame(np.unique(np.column_stack((np.minimum(x, y), np.maximum(x, y))), axis=0), columns=["a", "b"])

    return rows.mapInPandas(run, "a long, b long").distinct()


def _by_key(left: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Inner join; ``lookup`` is broadcast only if it is counted and small."""
    return left.join(F.broadcast(lookup) if lookup.count() <= BROADCAST_ROWS else lookup, key)


def _possible(pairs: DataFrame, owners: DataFrame, percent: int) -> DataFrame:
    """Pairs that sizes and fine sketches don't rule out; none that links is lost."""
    def fine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = pdf["x"].to_numpy(dtype=np.int64) + pdf["y"].to_numpy(dtype=np.int64)
            least = np.array([least_difference(x, y) for x, y in zip(pdf["sx"], pdf["sy"], strict=True)], dtype=np.int64)
            yield pdf.loc[least <= both - 2 * -(-percent * both // (100 + percent)), ["a", "b"]]

    for key, size, cells in (("a", "x", "sx"), ("b", "y", "sy")):
        pairs = pairs.join(owners.select(F.col("cls").alias(key), F.col("n_shingles").alias(size), F.col("fine").alias(cells)), key)
    near = pairs.filter(100 * F.least("x", "y") >= percent * F.greatest("x", "y"))
    return near.select("a", "b", "x", "y", "sx", "sy").mapInPandas(fine, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, owners: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` of classes whose sets have the wanted similarity."""
    pairs = materialize(_possible(pairs, owners, percent), "jaccard-possible")
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct().join(owners.select("cls", "doc_id", "text_key"), "cls")
    wanted = materialize(wanted.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "cls"), "jaccard-wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = docs.select("doc_id", "text").join(wanted, (F.xxhash64("text") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")))
    texts = texts.select("cls", "text").dropDuplicates(["cls"])  # rows may repeat

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            last, number, of = {}, [], []  # a centre's text is hashed once a batch
            for key, text in zip(pdf["b"], pdf["y"], strict=True):
                if key not in last:
                    last[key] = len(of)
                    of.append(text)
                number.append(last[key])
            lefts, rights, keep = gram_sets(pdf["x"].tolist(), n), gram_sets(of, n), []
            for left, i in zip(lefts, number, strict=True):
                both = len(np.intersect1d(left, rights[i], assume_unique=True))
                keep.append(100 * both >= percent * (len(left) + len(rights[i]) - both))
            yield pdf.loc[keep, ["a", "b"]]

    left = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("x")), "a")
    both = left.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("y")), "b")
    return materialize(both.select("a", "b", "x", "y").mapInPandas(run, "a long, b long"), "jaccard-links")


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for all nodes of ``links(a, b)``."""
    edges = materialize(_larger_first(links), "edges-0")
    for step in itertools.count(1):
        # all edges lead to a root if no edge's lesser end has a lesser neighbour itself
        if edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty() and edges.groupBy("u").count().filter("count > 1").isEmpty():
            break
        # large star: neighbours that are larger than a node go to the least of its neighbourhood
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = _larger_first(both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        # small star: a node and its smaller neighbours go to the least of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u")
        edges = _larger_first(moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(moved.select(F.col("u").alias("a"), F.col("m").alias("b"))))
        edges = materialize(edges, f"edges-{step}")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _larger_first(links: DataFrame) -> DataFrame:
    return links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _grouped(docs: DataFrame, n: int, percent: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_key, cls, n_shingles) and classes (cls, component, doc_id, text_key), the last two of one row of the class."""
    rows = materialize(sets(docs, n, percent), "jaccard-sets")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("least")
    owners = rows.filter("cls is not null").groupBy("cls").agg(least, F.min("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("fine").alias("fine"))
    owners = materialize(owners.select("cls", "least.doc_id", "least.text_key", "n_shingles", "sketch", "fine"), "jaccard-owners")
    shared = _allocated(_index(docs, n, percent), percent, hot)
    # every class and the centres it shares buckets with; of these, one
    center = F.min(F.struct("kind", "cls", "use", "near")).alias("c")
    starred = shared.join(shared.groupBy("sig").agg(center), "sig").select("cls", "kind", "use", *[F.col(f"c.{c}").alias(f"c_{c}") for c in ("cls", "kind", "use", "near")])
    starred = starred.filter((F.col("c_kind") == 0) & (F.col("c_cls") != F.col("cls"))).filter(_may_link("c_"))
    votes = starred.groupBy("cls", "c_cls").agg(F.count(F.lit(1)).alias("votes"))
    best = F.max_by("c_cls", F.struct("votes", -F.col("c_cls").cast("decimal(20,0)")))
    pairs = materialize(votes.groupBy("cls").agg(best.alias("b")).select(F.col("cls").alias("a"), "b"), "jaccard-first")
    known = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = verified(pairs, docs, owners, n, percent)
    for name, meet in (("spanning", _spanning), ("rest", _bucket_pairs)):
        found = materialize(components(links), f"jaccard-components-{name}")
        pairs = meet(_open_rows(shared, found, owners), percent)
        pairs = materialize(pairs.join(known, ["a", "b"], "left_anti"), f"jaccard-{name}")
        known = known.union(pairs)
        links = links.union(verified(pairs, docs, owners, n, percent))
    found = materialize(components(links), "jaccard-components")
    named = owners.select("cls", "doc_id", "text_key").join(found.withColumnRenamed("node", "cls"), "cls", "left")
    return rows, named.withColumn("component", F.coalesce("component", "cls"))


def join(docs: DataFrame, *, n: int = 4, percent: int = 85, hot: int = 16) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the least doc_id reachable by links)."""
    rows, classes = _grouped(docs, n, percent, hot)
    least = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    names = classes.select("cls", "component").join(least, "component").select("cls", "component_id")
    out = rows.join(names, "cls", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, *, n: int = 5, percent: int = 80, hot: int = 16) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the least doc_id, then of the least hash of its text.

    Rows without an id come last in their group; rows with an empty set all stay.  Of rows that
    repeat both the id and the text of the row that stays, one stays.
    """
    rows, classes = _grouped(docs, n, percent, hot)
    of_row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    least = classes.groupBy("component").agg(F.min(of_row).alias("least"))
    stays = classes.join(least, "component").filter(of_row == F.col("least")).select("cls", F.lit(True).alias("owner"), F.col("least"))
    marked = rows.filter("cls is not null").join(stays, "cls", "left").withColumn("stays", F.coalesce(of_row == F.col("least"), F.lit(False)))
    per_key = marked.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("rows"), F.first("stays").alias("stays"))
    per_key = materialize(per_key, "jaccard-kept").select(F.col("doc_id").alias("j_id"), F.col("text_key").alias("j_key"), "rows", "stays")
    here = (F.xxhash64("text") == F.col("j_key")) & F.col("doc_id").eqNullSafe(F.col("j_id"))
    few = lambda keys: F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    kept = docs.join(few(per_key.filter("not stays")), here, "left_anti")
    repeated = per_key.filter("stays and rows > 1")
    if repeated.isEmpty():
        return kept
    repeated = few(repeated)
    whole = F.struct(*docs.columns)
    once = kept.join(repeated, here, "left_semi").groupBy("doc_id", F.xxhash64("text")).agg(F.min_by(whole, F.xxhash64(*docs.columns)).alias("r")).select("r.*")
    return kept.join(repeated, here, "left_anti").select(*docs.columns).unionByName(once)


#: ``join`` with its defaults, by comparing all pairs that share an n-gram: for small tables.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) END AS grams FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.least_id, s.doc_id)) AS component_id
FROM s LEFT JOIN (SELECT a, min(b) AS least_id FROM reach GROUP BY a) m ON m.a = s.doc_id
"""
