"""Operator 4: personal data by information-theoretic sanitisation (DataFrame functions only).

Base spans are regular-expression matches that pass a check (Luhn, octets, digit counts).  Every value
found is a protected entity e, however rare.  A term t is a run of letters and digits that overlaps
no base span of its text.  Co-occurrence in whole documents says how much of an entity's information
the term gives away: with document counts n, N documents, and ``unseen`` pseudo-documents that hold
the term without the entity (so that a term seen once is not taken for certain),

    disclosure(t; e) = PMI(t; e) / IC(e) = log(N n_te / ((n_t + unseen) n_e)) / log(N / n_e)

In a document that holds e, terms that disclose at least ``generalise`` of it are generalised, those
from ``remove`` on removed, wherever they stand in the text.  Counts cover all rows of the table.

What keeps it whole and bounded: a term can reach the threshold only where n_t + unseen <=
n_e^g N^(1-g), as n_te <= n_e; commoner terms are ruled out before pairs are made, exactly.  Equal
texts are one text with a weight.  Entities with the same set of texts share all their counts and are
one profile, and one that occurs in a single text needs no counting of pairs.  What is paired is
then a text's profiles with its rare terms.  Joins look a row's key up in a table with one row a key, so
adaptive execution splits a key that holds a third of the rows; aggregates combine before shuffling.

Positions without Python: the pieces between the matches (``split``) and the matches themselves
(``regexp_extract_all``) alternate, so running sums of their lengths are the offsets, in code points.
The patterns are possessive, with starts anchored to the start of a run: they match the same spans
as the plain forms, in linear time and without recursion on very long texts.

Defined cases: null text is empty text; repeated rows give repeated results and count as documents;
an entity in every document has nothing left to disclose; an empty table gives an empty result;
other columns are ignored.  Documents without base spans get no added span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrievo.llm.storage import materialize

# The kinds in their order, and a pattern for each.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match: cheap to test.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TERM = r"[\p{L}\p{N}]+"
SPAN = "array<struct<start:int,kind_rank:int,end:int,kind:string,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total, i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        d = F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
        return total + d

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        def octet(part):
            number = F.regexp_replace(part, "^0+", "")
            return (F.length(number) < 3) | ((F.length(number) == 3) & (number <= "255"))
        return F.forall(F.split(value, r"\."), octet)
    digits = _digits(value)
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(10, 15)


def located(text: Column, pattern: str) -> Column:
    """All matches with their offsets: array<struct<start, end, value>>."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"), F.split(text, pattern, -1).alias("gap"))
    pairs = F.filter(pairs, lambda p: p["value"].isNotNull())
    ends = F.aggregate(
        pairs, F.array(F.lit(0)),
        lambda out, p: F.concat(out, F.array(F.element_at(out, -1) + F.length(p["gap"]) + F.length(p["value"]))),
    )
    spans = F.arrays_zip(pairs.alias("p"), F.slice(ends, 2, F.greatest(F.size(ends) - 1, F.lit(0))).alias("end"))
    return F.transform(
        spans,
        lambda s: F.struct((s["end"] - F.length(s["p"]["value"])).alias("start"), s["end"].alias("end"), s["p"]["value"].alias("value")),
    )


def base_spans(text: Column) -> Column:
    """Valid spans of all kinds, by start and then kind."""
    def of(rank, kind):
        valid = F.filter(located(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
        spans = F.transform(valid, lambda s: F.struct(s["start"], F.lit(rank).alias("kind_rank"), s["end"], F.lit(kind).alias("kind"), s["value"]))
        need = NEEDS[kind]
        return F.when(text.contains(need) if need else text.rlike("[0-9]"), spans).otherwise(F.array().cast(SPAN))

    return F.array_sort(F.concat(*[of(rank, kind) for rank, kind in enumerate(KINDS)]))


def entity(kind: Column, value: Column) -> Column:
    """One name for all ways to write a value."""
    return F.concat_ws(":", kind, F.when(kind.isin("card", "phone"), _digits(value)).otherwise(F.lower(value)))


def _terms(texts: DataFrame) -> DataFrame:
    """Every occurrence of a term outside the base spans: copy, term, start, end."""
    parts = F.arrays_zip(F.regexp_extract_all("body", F.lit(TERM), F.lit(0)).alias("value"), F.split("body", TERM, -1).alias("gap"))
    order = Window.partitionBy("copy")
    found = texts.select("copy", F.posexplode(parts).alias("i", "p")).filter("p.value IS NOT NULL")
    found = found.withColumn("end", F.sum(F.length("p.gap") + F.length("p.value")).over(order.orderBy("i")).cast("int"))
    found = found.select("copy", F.lower("p.value").alias("term"), (F.col("end") - F.length("p.value")).alias("start"), "end")
    spans = texts.select("copy", F.explode("base").alias("s")).select("copy", F.lit(None).cast("string").alias("term"), "s.start", "s.end")
    is_base = F.col("term").isNull()
    marked = found.unionByName(spans).select(
        "*",
        F.max(F.when(is_base, F.col("end"))).over(order.orderBy("start", F.col("term").asc_nulls_first())).alias("before"),
        F.min(F.when(is_base, F.col("start"))).over(order.orderBy(F.desc("start"), F.col("term").desc_nulls_last())).alias("after"),
    )
    return marked.filter("term IS NOT NULL AND coalesce(before <= start, true) AND coalesce(after >= end, true)").select("copy", "term", "start", "end")


def disclosing(
    found: DataFrame, docs: DataFrame, *, unseen: float, generalise: float, remove: float,
) -> DataFrame:
    """Occurrences of disclosing terms: copy, added (spans by start), for the texts that have any."""
    total = found.count()
    holders = found.filter(F.size("base") > 0)
    texts = holders.groupBy("copy").agg(F.first("body").alias("body"), F.first("base").alias("base"))
    terms = materialize(_terms(texts), "pii-terms")

    entities = F.array_distinct(F.transform("base", lambda s: entity(s["kind"], s["value"])))
    mentions = holders.select("copy", F.explode(entities).alias("entity")).groupBy("copy", "entity").agg(F.count(F.lit(1)).alias("w"))
    mentions = materialize(mentions, "pii-mentions")
    counts = mentions.groupBy("entity").agg(
        F.sum("w").alias("n_e"), (F.count(F.lit(1)) == 1).alias("alone"),
        F.bit_xor(F.xxhash64("copy")).alias("set_a"), F.bit_xor(F.xxhash64("copy", F.lit(1))).alias("set_b"),
    )
    profiles = mentions.join(counts, "entity").filter(F.col("n_e") < total)  # else IC is 0
    profiles = materialize(profiles.select("copy", "w", "n_e", "alone", "set_a", "set_b").distinct(), "pii-profiles")

    def most(n_e: Column) -> Column:  # documents that a term may be in; the factor outweighs rounding
        return F.pow(n_e, F.lit(generalise)) * F.pow(F.lit(float(total)), F.lit(1 - generalise)) * (1 + 1e-6) - unseen

    largest = profiles.agg(F.max("n_e")).first()[0] or 0
    # lower case after the extraction, as in _terms: some letters become two, of which one is no letter
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower))
    frequency = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    frequency = frequency.filter(F.col("n_t") <= most(F.lit(largest)))
    pairs = terms.select("copy", "term").distinct().join(frequency, "term").join(profiles, "copy")
    pairs = materialize(pairs.filter(F.col("n_t") <= most(F.col("n_e"))), "pii-pairs")

    information = F.log(F.lit(float(total)) / F.col("n_e"))
    share = F.round(F.log(F.lit(float(total)) * F.col("n_te") / ((F.col("n_t") + unseen) * F.col("n_e"))) / information, 9)
    own = pairs.filter("alone").withColumn("n_te", F.col("n_e")).select("copy", "term", share.alias("share"))
    key = ["set_a", "set_b", "term"]
    shared = pairs.filter("NOT alone")
    told = shared.groupBy(key).agg(F.sum("w").alias("n_te"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e"))
    told = told.select(*key, share.alias("share")).filter(F.col("share") >= generalise)
    told = shared.select("copy", *key).join(told, key).select("copy", "term", "share").unionByName(own.filter(F.col("share") >= generalise))
    kind = F.when(F.max("share") >= remove, F.lit("remove")).otherwise(F.lit("generalise"))
    added = terms.join(told.groupBy("copy", "term").agg(kind.alias("kind")), ["copy", "term"])
    span = F.struct("start", F.lit(len(KINDS)).alias("kind_rank"), "end", "kind", F.col("term").alias("value"))
    return added.groupBy("copy").agg(F.sort_array(F.collect_list(span)).alias("added"))  # spans of one document


def sanitise(docs: DataFrame, *, unseen: float = 1.0, generalise: float = 0.8, remove: float = 0.9) -> DataFrame:
    """One row per document: doc_id, base and added (array<struct<start, kind_rank, end, kind, value>>), and
    body, the text of documents with base spans (null for all others)."""
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body")).withColumn("base", base_spans(F.col("body")))
    holds = F.size("base") > 0
    found = found.select("doc_id", "base", F.when(holds, F.col("body")).alias("body"), F.when(holds, F.md5("body")).alias("copy"))
    found = materialize(found, "pii-found")
    added = disclosing(found, docs, unseen=unseen, generalise=generalise, remove=remove)
    columns = ["doc_id", "base", F.coalesce("added", F.array().cast(SPAN)).alias("added"), "body"]
    plain = found.filter(~holds).withColumn("added", F.array().cast(SPAN))
    return found.filter(holds).join(added, "copy", "left").select(columns).unionByName(plain.select(columns))


def generalised(term: Column) -> Column:
    """A wider form of a term: a number by its order of magnitude, any other term by its class."""
    number = F.concat(F.substring(term, 1, 1), F.repeat(F.lit("0"), F.length(term) - 1))
    return F.when(term.rlike(r"^[0-9]+$"), number).when(term.rlike(r"\p{N}"), F.lit("<code>")).otherwise(F.lit("<term>"))


def sanitised(docs: DataFrame, **thresholds: float) -> DataFrame:
    """doc_id and text of every document: values give way to their kind in angle brackets, terms that
    disclose much to a wider form, terms that disclose most to nothing.  Of overlapping base spans the first
    by start and kind is named, and all that they cover goes.  Texts without base spans are unchanged
    (null: empty)."""
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body")).withColumn("whole", F.md5("body"))
    spans = sanitise(docs, **thresholds).filter(F.col("body").isNotNull())
    spans = spans.groupBy(F.md5("body").alias("whole")).agg(F.first(F.array_sort(F.concat("base", "added"))).alias("spans"))

    def step(done: Column, s: Column) -> Column:
        new = F.when(s["kind"] == "remove", F.lit("")).when(s["kind"] == "generalise", generalised(s["value"])).otherwise(F.concat(F.lit("<"), s["kind"], F.lit(">")))
        gap = F.substring(F.col("body"), done["end"] + 1, F.greatest(s["start"] - done["end"], F.lit(0)))
        piece = F.when(s["start"] >= done["end"], F.concat(gap, new)).otherwise(F.lit(""))
        return F.struct(F.concat(done["text"], piece).alias("text"), F.greatest(done["end"], s["end"]).alias("end"))

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("end"))
    text = F.aggregate("spans", start, step, lambda d: F.concat(d["text"], F.substring(F.col("body"), d["end"] + 1, F.length("body"))))
    return found.join(spans, "whole", "left").select("doc_id", F.coalesce(text, F.col("body")).alias("text"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from the operator's spans."""
    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


#: ``digest(sanitise(documents))`` with the defaults.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS body, text FROM documents),
base AS (
  SELECT row, 0 AS kind_rank, 'email' AS kind, start, start + length(value) AS "end", value FROM (
    SELECT row, value, regexp_replace(value, '[^0-9]', '', 'g') AS digits, CAST(list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
    FROM (SELECT row, found, gaps, unnest(found) AS value, generate_subscripts(found, 1) AS i FROM (SELECT row, regexp_extract_all(body, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS found, regexp_split_to_array(body, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS gaps FROM d)))
  WHERE true
  UNION ALL SELECT row, 1 AS kind_rank, 'ip' AS kind, start, start + length(value) AS "end", value FROM (
    SELECT row, value, regexp_replace(value, '[^0-9]', '', 'g') AS digits, CAST(list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
    FROM (SELECT row, found, gaps, unnest(found) AS value, generate_subscripts(found, 1) AS i FROM (SELECT row, regexp_extract_all(body, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS found, regexp_split_to_array(body, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS gaps FROM d)))
  WHERE list_bool_and(list_transform(string_split(value, '.'), lambda x: coalesce(TRY_CAST(x AS HUGEINT) <= 255, false)))
  UNION ALL SELECT row, 2 AS kind_rank, 'card' AS kind, start, start + length(value) AS "end", value FROM (
    SELECT row, value, regexp_replace(value, '[^0-9]', '', 'g') AS digits, CAST(list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
    FROM (SELECT row, found, gaps, unnest(found) AS value, generate_subscripts(found, 1) AS i FROM (SELECT row, regexp_extract_all(body, '[0-9]([\x20-]?[0-9])+') AS found, regexp_split_to_array(body, '[0-9]([\x20-]?[0-9])+') AS gaps FROM d)))
  WHERE length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(length(digits)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(digits, length(digits) - i, 1) AS INTEGER) ELSE 2 * CAST(substr(digits, length(digits) - i, 1) AS INTEGER) - CASE WHEN CAST(substr(digits, length(digits) - i, 1) AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0
  UNION ALL SELECT row, 3 AS kind_rank, 'phone' AS kind, start, start + length(value) AS "end", value FROM (
    SELECT row, value, regexp_replace(value, '[^0-9]', '', 'g') AS digits, CAST(list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
    FROM (SELECT row, found, gaps, unnest(found) AS value, generate_subscripts(found, 1) AS i FROM (SELECT row, regexp_extract_all(body, '\+[0-9][\x20().0-9-]+[0-9]') AS found, regexp_split_to_array(body, '\+[0-9][\x20().0-9-]+[0-9]') AS gaps FROM d)))
  WHERE length(digits) BETWEEN 10 AND 15),
mentions AS (
  SELECT DISTINCT row, CASE WHEN kind IN ('card', 'phone') THEN kind || ':' || regexp_replace(value, '[^0-9]', '', 'g') ELSE kind || ':' || lower(value) END AS entity FROM base),
terms AS (
  SELECT row, lower(t) AS term, CAST(sum(length(t) + length(gap)) OVER (PARTITION BY row ORDER BY i) AS BIGINT) AS "end", "end" - length(t) AS start FROM (
    SELECT row, found[i] AS t, gaps[i] AS gap, i FROM (
      SELECT row, found, gaps, generate_subscripts(found, 1) AS i FROM (
        SELECT row, regexp_extract_all(body, '[\p{L}\p{N}]+') AS found, regexp_split_to_array(body, '[\p{L}\p{N}]+') AS gaps FROM d WHERE row IN (SELECT row FROM base))))),
beside AS (SELECT * FROM terms WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row = terms.row AND b.start < terms."end" AND terms.start < b."end")),
entities AS (SELECT entity, count(*) AS n_e FROM mentions GROUP BY entity),
pairs AS (
  SELECT entity, term, any_value(n_e) AS n_e, count(*) AS n_te FROM (SELECT DISTINCT row, term FROM beside) JOIN mentions USING (row) JOIN entities USING (entity) GROUP BY entity, term),
freq AS (SELECT term, count(*) AS n_t FROM (SELECT DISTINCT row, lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}]+'))) AS term FROM d) GROUP BY term),
told AS (
  SELECT entity, term, round(ln(n::DOUBLE * n_te / ((n_t + 1.0::DOUBLE) * n_e)) / ln(n::DOUBLE / n_e), 9) AS share FROM pairs JOIN freq USING (term), (SELECT count(*) AS n FROM d) WHERE n_e < n),
added AS (
  SELECT row, 4 AS kind_rank, max(CASE WHEN share >= 0.9 THEN 'remove' ELSE 'generalise' END) AS kind, start, "end", term AS value
  FROM beside JOIN mentions USING (row) JOIN told USING (entity, term) WHERE share >= 0.8 GROUP BY row, start, "end", term)
SELECT d.doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone, sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(s.spans, '') AS spans
FROM d LEFT JOIN (SELECT row, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
    string_agg(kind || ':' || start::BIGINT || ':' || "end"::BIGINT, ',' ORDER BY start, kind_rank) AS spans FROM base GROUP BY row) b USING (row)
LEFT JOIN (SELECT row, string_agg(kind || ':' || start::BIGINT || ':' || "end"::BIGINT, ',' ORDER BY start, kind_rank, "end", kind, value) AS spans FROM (SELECT row, kind_rank, kind, start, "end", value FROM base UNION ALL SELECT row, kind_rank, kind, start, "end", value FROM added) GROUP BY row) s USING (row)
"""
