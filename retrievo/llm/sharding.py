"""Operator 3: sharding by sampled splitters (DataFrame functions only).

Records are range-partitioned by the 64-bit hash of their text, so equal texts are neighbours.

1. A size-weighted sample: a record is drawn with probability ``size * samples / total`` (decided by
   a hash, so reruns agree).  Weighted quantiles of the sample are the splitters of ``ranges`` ranges.
2. A text that holds more than a range's share of all bytes is a hot key; there are fewer than
   ``ranges`` of them.  Such a key is subdivided by document into parts of about a range's share.
3. Ranges and parts are measured exactly; their prefix sums, and running sums inside each, give every
   record its exact byte interval.  A record goes to the shard in which its middle lies; equal
   texts that together are small (1/64 of a shard) go by the middle of the group and stay together.

The law is ``bytes``: shards differ by a record, or a small group, at most.  Broadcast tables have
one row per range, per hot key or per part: O(ranges), whatever the input.

Defined cases: null text has no bytes (size 1, CRC 0) and is its own key; repeated rows are
separate records; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retrievo.llm.storage import materialize

PREFIX_BITS = 10


def _range_index(base: DataFrame, total: int, samples: int, ranges: int) -> DataFrame:
    """One row for each of the 1,024 key prefixes: splitters below it, and those inside, in order."""
    spark = base.sparkSession
    chance = F.col("size") * F.lit(samples / total)
    draw = F.pmod(F.xxhash64("doc_id", "key", F.lit("sample")), F.lit(1 << 31)) / F.lit(float(1 << 31))
    sample = base.filter(draw < chance).select("key", F.greatest(F.lit(1.0), chance).alias("weight"))
    upto = F.sum("weight").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    every = F.sum("weight").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    cut = F.floor(upto * ranges / every)
    splitters = sample.select("key", cut.alias("cut")).filter(f"cut < {ranges}").groupBy("cut").agg(F.max("key").alias("key")).select("key").distinct()
    prefix = (F.shiftright("key", 64 - PREFIX_BITS) + (1 << (PREFIX_BITS - 1))).cast("int")
    inside = splitters.groupBy(prefix.alias("prefix")).agg(F.sort_array(F.collect_list("key")).alias("splits"))
    every_prefix = spark.range(1 << PREFIX_BITS).select(F.col("id").cast("int").alias("prefix")).join(inside, "prefix", "left")
    below = F.sum(F.coalesce(F.size("splits"), F.lit(0))).over(Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1))
    splits = F.coalesce("splits", F.array().cast("array<bigint>"))
    return every_prefix.withColumn("splits", splits).select("prefix", "splits", F.coalesce(below, F.lit(0)).alias("below"))


def shard(docs: DataFrame, *, shards: int = 16, samples: int = 8192, ranges: int = 1024) -> DataFrame:
    """One row per record: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    base = materialize(
        docs.select(
            "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce("text", F.lit(""))).cast("long").alias("text_crc32"), F.xxhash64("text").alias("key"),
        ),
        "shard-base",
    )
    total = base.agg(F.sum("size")).first()[0] or 1
    prefix = (F.shiftright("key", 64 - PREFIX_BITS) + (1 << (PREFIX_BITS - 1))).cast("int")
    ranged = base.withColumn("prefix", prefix).join(F.broadcast(_range_index(base, total, samples, ranges)), "prefix")
    ranged = ranged.withColumn("range", F.col("below") + F.size(F.filter("splits", lambda s: s < F.col("key")))).drop("prefix", "splits", "below")
    share = total / ranges
    hot = base.groupBy("key").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > share)
    hot = hot.select("key", F.ceil(F.col("bytes") / share).alias("parts"))  # fewer than `ranges` rows
    ranged = ranged.join(F.broadcast(hot), "key", "left").withColumn(
        # in key order: what lies before the hot keys of a range, each hot key's parts, ...
        "part", F.when(F.col("parts").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("doc_id", F.lit("part")), F.col("parts"))).cast("long"),
    )
    ranged = ranged.withColumn("hot", F.when(F.col("part") >= 0, F.col("key"))).drop("parts")
    chunk = ["range", "hot", "part"]
    sums = ranged.groupBy(*chunk).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy(F.col("range"), F.col("hot").asc_nulls_first(), F.col("part")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(c).alias(f"c_{c}") for c in chunk],
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_start"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row_start"),
    )
    same = F.col("range").eqNullSafe(F.col("c_range")) & F.col("hot").eqNullSafe(F.col("c_hot")) & (F.col("part") == F.col("c_part"))
    placed = ranged.join(F.broadcast(offsets), same)  # under three rows a range
    running = Window.partitionBy(*chunk).orderBy("key", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*chunk, "key")
    placed = placed.select(
        "doc_id", "size", "text_crc32", *chunk, "key", "byte_start",
        (F.col("byte_start") + F.coalesce(F.sum("size").over(running), F.lit(0))).alias("start"),
        (F.col("row_start") + F.row_number().over(Window.partitionBy(*chunk).orderBy("key", "doc_id", "text_crc32", "size")) - 1).alias("row"),
    )
    placed = placed.withColumn("group_bytes", F.sum("size").over(group)).withColumn("group_start", F.min("start").over(group))
    together = F.col("hot").isNull() & (F.col("group_bytes") <= total / shards / 64)
    middle = F.when(together, F.col("group_start") + F.col("group_bytes") / 2).otherwise(F.col("start") + F.col("size") / 2)
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / total)).cast("int"))
    placed = materialize(placed.select("doc_id", "size", "text_crc32", "shard", "row"), "shard-placed")
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # a row for each shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first_row")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
