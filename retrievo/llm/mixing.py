"""Operator 1: mixing sources to target weights by a time-varying curriculum (DataFrame functions only).

Sources share the whole budget by weight; a target stops at ``repeat_cap`` times its source's size
and the excess goes to the others by weight.  In the order of cap/weight the capped sources are a
prefix, so one running sum replaces the rounds of resharing.

Every source has a linear weight schedule over training time t in [0, 1], ``1 + a (2 t - 1)``.  Its
integral ``(1 - a) t + a t^2`` is the share of the source's tokens wanted up to t; the inverse at a
document's place in its source's token stream is the document's training position, and the result
is range-sorted by position.

The place in the stream is an exact distributed prefix sum: documents are ordered by the MD5 of
their id and text, a source is cut into ``16 ** digits`` ranges of that order, ranges are summed first and
rows are summed only inside a range, so a source with a third of all rows is no single task.

Defined cases: null or blank text has size 0 and is taken 0 times; a null source sorts last and is
a source of its own; an empty table gives an empty result; repeated rows and rows without doc_id are
documents like others;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retrievo.llm.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]*"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _cycle(values: Sequence[float], rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (rank % len(values) + 1).cast("int"))


def targets(sizes: DataFrame, weights: Sequence[float], repeat_cap: int, ramps: Sequence[float]) -> DataFrame:
    """``sizes(skey, source_size)`` with ``target`` and the schedule's slope ``ramp`` for each source.

    One row per source; the windows over all of them see that small table only.
    """
    ordered = sizes.withColumn("rank", F.row_number().over(Window.orderBy("skey")) - 1)
    ordered = ordered.select(
        "skey", "source_size", _cycle(weights, F.col("rank")).alias("weight"), _cycle(ramps, F.col("rank")).alias("ramp"),
        (F.col("source_size") * repeat_cap).alias("cap"),
    ).withColumn("level", F.col("cap") / F.col("weight"))
    everything = Window.orderBy("level", "skey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("level", "skey").rowsBetween(Window.unboundedPreceding, -1)
    filled = ordered.select(
        "*",
        ((F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
         / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("share"),
    )
    free = F.when(F.col("share") < F.col("level"), F.col("share"))
    filled = filled.withColumn("price", F.first(free, ignorenulls=True).over(everything))
    target = F.when(F.col("price").isNull() | (F.col("level") <= F.col("price")), F.col("cap").cast("double"))
    return filled.select("skey", "source_size", "ramp", target.otherwise(F.col("weight") * F.col("price")).alias("target"))


#: What tells a document from others, beside its doc_id.
KEY = ("skey", "text_key")


def _key() -> list[Column]:
    source = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    return [source.alias("skey"), F.xxhash64("text").alias("text_key")]


def _order() -> Column:
    """Places documents in a stream: even where ids repeat or are null."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")))))


def mix(
    docs: DataFrame, *, weights: Sequence[float] = (1, 2, 3), repeat_cap: int = 3, ramps: Sequence[float] = (-0.5, 0.0, 0.5), digits: int = 3,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, position.

    ``taken`` counts the words the mix takes: whole passes over the source, and one last pass that
    ends at the target, so at most one document of a source is cut.  ``position`` in [0, 1] is that
    of the document's first copy, null if it isn't taken.
    """
    sized = materialize(
        docs.select("doc_id", "source", *_key(), _order().alias("ord"), word_count(F.col("text")).alias("size")).withColumn("part", F.substring("ord", 1, digits)),
        "mix-sizes",
    )
    parts = sized.groupBy("skey", "part").agg(F.sum("size").alias("part_size"))
    goal = targets(parts.groupBy("skey").agg(F.sum("part_size").alias("source_size")), weights, repeat_cap, ramps)
    running = Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("skey", "part", F.coalesce(F.sum("part_size").over(running), F.lit(0)).alias("part_start")).join(goal, "skey")
    inside = Window.partitionBy("skey", "part").orderBy("ord", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(starts, ["skey", "part"]).withColumn(
        "start", F.col("part_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    )
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")
    placed = placed.withColumn("passes", passes).withColumn("last", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start"))))
    placed = placed.withColumn("taken", (F.col("passes") * F.col("size") + F.col("last")).cast("long"))
    return (
        placed.withColumn("position", F.when(F.col("taken") > 0, _position(F.lit(0))))
        .select("doc_id", "size", "source_size", "target", "taken", "source", F.round("position", 9).alias("position"),
                "passes", "last", "start", "ramp", *KEY)
        .orderBy("position", "doc_id")
    )


def _position(copy: Column) -> Column:
    """Training time of a copy: the inverse of the integrated schedule at the copy's middle word."""
    middle = copy * F.col("source_size") + F.col("start") + F.least(F.col("size"), F.col("taken")) / 2
    share = F.least(F.lit(1.0), middle / F.col("target"))
    flat = 1 - F.col("ramp")
    root = (F.sqrt(flat * flat + 4 * F.col("ramp") * share) - flat) / (2 * F.col("ramp"))
    return F.when(F.col("ramp") == 0, share).otherwise(root)


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every taken copy as a row with the columns of ``docs``, range-sorted by position.

    The copy of the last pass at which a source's target ends is cut after its last taken word, and
    its ``n_chars`` follows.  A row finds its plan by doc_id, source and text; rows that repeat all
    three are dealt the plans of their like.
    """
    plan = mix(docs, **options).drop("source", "position")
    # of any input columns, only these names are added
    rows = docs.select(F.struct(*docs.columns).alias("mix_row"), "doc_id", "text", *_key())
    like = Window.partitionBy("doc_id", *KEY)
    plan = materialize(plan.withColumn("twin", F.row_number().over(like.orderBy(F.desc("taken"), "start"))), "mix-plan")
    if plan.filter("twin > 1").isEmpty():
        rows = rows.withColumn("twin", F.lit(1))
    else:
        rows = rows.withColumn("twin", F.row_number().over(like.orderBy(F.xxhash64("mix_row"))))
    plan = plan.filter("taken > 0")
    copies = plan.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("passes") + F.when(F.col("last") > 0, 1).otherwise(0) - 1).cast("int"))))
    words = F.when(F.col("copy") < F.col("passes"), F.col("size")).otherwise(F.col("last"))
    copies = copies.select(
        F.col("doc_id").alias("plan_id"), *[F.col(k).alias(f"plan_{k}") for k in (*KEY, "twin")],
        _position(F.col("copy")).alias("position"), "copy", F.when(words < F.col("size"), words).alias("cut"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("plan_id"))
    for k in (*KEY, "twin"):
        same &= F.col(k) == F.col(f"plan_{k}")
    cut = F.col("cut")
    head = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(f"{BLANK}{WORD}"), F.lit(0)), 1, cut.cast("int")), "")
    mixed = rows.join(copies, same).withColumn("text", F.when(cut.isNotNull(), head).otherwise(F.col("text"))).orderBy("position", "doc_id", "copy")
    columns = {c: F.col(f"mix_row.`{c}`") for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(cut.isNotNull(), F.length("text").cast("long")).otherwise(columns["n_chars"])
    return mixed.select(*[column.alias(c) for c, column in columns.items()])


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS ord,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
per AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY skey),
ranked AS (SELECT *, row_number() OVER (ORDER BY skey) - 1 AS rk FROM per),
weighted AS (
  SELECT skey, source_size, CAST(rk % 3 + 1 AS DOUBLE) AS weight, (rk % 3 - 1) * CAST(0.5 AS DOUBLE) AS ramp, source_size * 3 AS cap,
         (source_size * 3) / CAST(rk % 3 + 1 AS DOUBLE) AS level FROM ranked),
shared AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY level, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY level, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS share
  FROM weighted),
priced AS (SELECT *, (SELECT arg_min(share, level) FROM shared WHERE share < level) AS price FROM shared),
goal AS (SELECT skey, source_size, ramp, CASE WHEN price IS NULL OR level <= price THEN CAST(cap AS DOUBLE) ELSE weight * price END AS target FROM priced),
placed AS (
  SELECT s.*, g.source_size, g.ramp, g.target,
         coalesce(sum(size) OVER (PARTITION BY s.skey ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN goal g ON s.skey = g.skey),
passed AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM placed),
counted AS (SELECT *, passes * size + greatest(0, least(size, round(target - passes * source_size) - start)) AS took FROM passed),
shares AS (SELECT *, least(CAST(1 AS DOUBLE), (start + least(size, took) / CAST(2 AS DOUBLE)) / target) AS f FROM counted)
SELECT doc_id, size, source_size, target, CAST(took AS BIGINT) AS taken, source,
       CASE WHEN took > 0 THEN round(CASE WHEN ramp = 0 THEN f ELSE (sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * f) - (1 - ramp)) / (2 * ramp) END, 9) END AS position
FROM shares
"""
