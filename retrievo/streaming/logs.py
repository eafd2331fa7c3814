"""Append-only logs as streams: resume, latest state, retries, event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """A folder of JSON lines as a stream; lines that can't be parsed are dropped.  ``max_files`` bounds a batch."""
    reader = spark.readStream.schema(f"{schema}, _broken STRING").option("columnNameOfCorruptRecord", "_broken")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path).filter("_broken is null").drop("_broken")


def append_new(log: DataFrame, key: str, path: str, checkpoint: str):
    """Write each key once, across restarts: the state of the keys is in the checkpoint."""
    return log.dropDuplicates([key]).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def upsert(log: DataFrame, keys: list[str], order: str, path: str, checkpoint: str):
    """Keep the latest record of each key as a table that every batch replaces in a new version folder."""
    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = f"{path}/v{epoch - 1}"
        if epoch > 0:
            batch = batch.unionByName(spark.read.parquet(old))
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
        batch.withColumn("_n", rank).filter("_n = 1").drop("_n").write.mode("overwrite").parquet(f"{path}/v{epoch}")

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resumed(log: DataFrame, key: str, path: str, checkpoint: str, every: int = 5, fail_at: int | None = None):
    """Write each key once to ``path``, whatever the restarts, with a full export every ``every`` batches.

    A batch owns the folder of its number, which a replay after a crash overwrites, so nothing is
    written twice; keys of earlier batches are left out by an anti-join with the folders before it.
    ``export`` beside it holds all rows up to the last multiple of ``every``, in a folder that only
    counts once it is whole.  ``fail_at`` breaks off in that batch after half of its work, for tests.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        before = [f"{path}/batch={i}" for i in range(number)]
        if before:
            fresh = fresh.join(spark.read.schema(batch.schema).parquet(*before).select(key), key, "left_anti").select(*batch.columns)
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if number == fail_at:
            raise RuntimeError("broken off")
        if (number + 1) % every == 0:
            whole = spark.read.schema(batch.schema).parquet(*before, f"{path}/batch={number}")
            whole.write.mode("overwrite").json(f"{path}-export/upto={number}")

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# What an annotator may do.
LABELS = ("RELEVANT", "NOT_RELEVANT")
ACTIONS = ("label", "flag", "unflag", "submit")


def folded(actions: DataFrame) -> DataFrame:
    """annotator, pair_id, label, flagged of ``actions(seq, annotator, pair_id, action, label)`` in the order of seq.

    The last label of a pair counts; a flag stands until it is taken back; nothing that comes after an
    annotator's first ``submit`` counts, nor labels and actions that don't exist, nor what names no
    annotator or, but for ``submit``, no pair.  Pairs that have neither label nor flag are left out.
    """
    actions = actions.filter("annotator is not null and (pair_id is not null or action = 'submit')")
    valid = F.col("action").isin("flag", "unflag") | ((F.col("action") == "label") & F.col("label").isin(*LABELS))
    submitted = actions.filter("action = 'submit'").groupBy("annotator").agg(F.min("seq").alias("submitted"))
    open_ = actions.filter(valid).join(submitted, "annotator", "left").filter("submitted is null or seq < submitted")
    last = lambda what, when: F.max_by(what, F.when(when, F.col("seq")))
    out = open_.groupBy("annotator", "pair_id").agg(
        last("label", F.col("action") == "label").alias("label"), F.coalesce(last("action", F.col("action").isin("flag", "unflag")) == "flag", F.lit(False)).alias("flagged"),
    )
    return out.filter("label is not null or flagged")


def label_store(actions: DataFrame, path: str, checkpoint: str):
    """``folded`` kept up by a stream: each batch writes a version of the labels, flags and submissions so far.

    A version is a folder of the batch's number, made from the one before, so a replayed batch makes the
    same version again.  Actions of a batch count in the order of seq; batches come in order.
    """
    state = "annotator STRING, pair_id BIGINT, label STRING, label_seq BIGINT, flag STRING, flag_seq BIGINT, submitted BIGINT"

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.schema(state).parquet(f"{path}/v{number - 1}") if number else spark.createDataFrame([], state)
        valid = batch.filter("annotator is not null and (pair_id is not null or action = 'submit')").filter(F.col("action").isin(*ACTIONS) & ((F.col("action") != "label") | F.col("label").isin(*LABELS)))
        is_label, is_flag = F.col("action") == "label", F.col("action").isin("flag", "unflag")
        new = valid.select(
            "annotator", F.when(F.col("action") != "submit", F.col("pair_id")).alias("pair_id"), F.when(is_label, F.col("label")).alias("label"), F.when(is_label, F.col("seq")).alias("label_seq"),
            F.when(is_flag, F.col("action")).alias("flag"), F.when(is_flag, F.col("seq")).alias("flag_seq"), F.when(F.col("action") == "submit", F.col("seq")).alias("submitted"),
        )
        both = old.unionByName(new)
        locked = both.groupBy("annotator").agg(F.min("submitted").alias("lock"))
        both = both.join(locked, "annotator").filter("submitted is not null or lock is null or coalesce(label_seq, flag_seq) < lock or (pair_id is not null and label_seq is not null and flag_seq is not null)")
        rows = both.groupBy("annotator", "pair_id").agg(
            F.max_by("label", "label_seq").alias("label"), F.max("label_seq").alias("label_seq"), F.max_by("flag", "flag_seq").alias("flag"), F.max("flag_seq").alias("flag_seq"), F.min("submitted").alias("submitted"),
        )
        rows.write.mode("overwrite").parquet(f"{path}/v{number}")

    return actions.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def labels_of(spark: SparkSession, path: str, version: int) -> DataFrame:
    rows = spark.read.parquet(f"{path}/v{version}").filter("pair_id is not null")
    flagged = F.coalesce(F.col("flag") == "flag", F.lit(False))
    return rows.select("annotator", "pair_id", "label", flagged.alias("flagged")).filter("label is not null or flagged")


def todo(all_rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return all_rows.join(done.select(key).distinct(), key, "left_anti")


def to_retry(log: DataFrame, key: str, text: str = "text", laws: str = "relevant_laws") -> DataFrame:
    """Keys whose last record has an error, no text or no laws."""
    bad = F.col("error").isNotNull() | F.coalesce(F.length(F.trim(text)) == 0, F.lit(True)) | (F.coalesce(F.size(laws), F.lit(0)) < 1)
    return log.filter(bad).select(key).distinct()


def _watermarked(events: DataFrame, late: str) -> DataFrame:
    """Streams need an instant to measure lateness by; times without a zone are those of the session."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows; the same on a table and on a stream."""
    rows = _watermarked(events, late)
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = rows.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum(F.col("value").cast("decimal(18,4)")), 4).cast("double").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    rows = _watermarked(events, late)
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
