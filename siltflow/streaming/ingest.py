"""The incremental run: messages to items to blobs and seen files, exactly once, then build and publish what changed.

The checkpoint holds which files of the feed were read; the store holds the keys seen, and each source's offset. A
batch's tables are committed together, under the batch's id, so a batch that is run again after a failure adds nothing.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators.keyed import first_per_key, unseen, upsert
from ..operators.messages import items
from ..operators.stats import ingest_stats
from ..schemas import BLOBS, SEEN_FILES, SOURCE_STATE
from ..sources.files import Store
from ..sources.sinks import save_blobs


def new_items(stream: DataFrame, within: str | None = None) -> DataFrame:
    """Items whose (source_id, external_id) is new to the stream; within: how long keys are kept, by event time."""
    keys = ["source_id", "external_id"]
    if within is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def with_ids(rows: DataFrame, keys: list[str], batch_id: int, by: list[str] | None = None) -> DataFrame:
    """id: batch_id * 2^33 + 1, 2 ... in an order that depends on the keys alone; rows with equal values of `by`, the
    first keys, are in the order of the rest. Rows are numbered within 1024 buckets, whose sizes are summed up before,
    so no task has to hold them all."""
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(*(by or keys)), F.lit(1024)))
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", (F.sum("_n").over(W.orderBy("_b")) - F.col("_n")).alias("_before"))
    number = F.col("_before") + F.row_number().over(W.partitionBy("_b").orderBy(*keys))
    return rows.join(before, "_b").withColumn("id", F.lit(batch_id * (1 << 33)) + number).drop("_b", "_before")


def record(store: Store, batch: DataFrame, tag: str = "") -> DataFrame:
    """Adds a batch of items to blobs and seen_files, all or nothing; returns the rows of seen_files that it added, also
    when a batch of that tag is run again. Of items with one key, the first by time and name counts, in both tables."""
    keys = ["source_id", "external_id"]
    if (done := store.tagged(tag)) is not None:
        return added(store, done)
    with store.transaction(tag) as n:
        first = first_per_key(batch.select(*keys, "data", "filename", "ts", "is_text"), keys, ["ts", "filename", "data"])
        with store.kept(unseen(first, store.read("seen_files", SEEN_FILES), keys)) as new:
            blobs = save_blobs(new.where("data is not null"), store.read("blobs", BLOBS))
            files = with_ids(new, keys, n).select(
                "id", *keys, F.sha2(F.coalesce("data", F.lit(b"")), 256).alias("raw_hash"), F.current_timestamp().alias("ingested_at"), F.coalesce(F.octet_length("data"), F.lit(0)).cast("bigint").alias("file_size"),
                "filename", F.to_json(F.struct("ts", "is_text")).alias("metadata_json"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error_msg"),
            )
            store.together(lambda s: s.append("blobs", blobs), lambda s: s.append("seen_files", files))
    return added(store, n)


def added(store: Store, n: int) -> DataFrame:
    """The rows of seen_files of transaction n."""
    return store.read("seen_files", SEEN_FILES).where((F.col("id") > n * (1 << 33)) & (F.col("id") <= (n + 1) * (1 << 33)))


def record_sources(store: Store, judged: DataFrame, messages: DataFrame, sources: DataFrame, n: int, now: float) -> None:
    """Within the batch's transaction, after record(): each source's offset, which never falls, and statistics; and how
    many items were dropped for each reason. judged: as by judged_items()."""
    began = time.time()
    new = added(store, n).select("source_id", "external_id", "file_size").withColumn("is_new", F.lit(True))
    items = judged.where("reason is null").select("source_id", "external_id", "is_text").distinct().join(new, ["source_id", "external_id"], "left")
    per = ingest_stats(items.select("source_id", F.coalesce("is_new", F.lit(False)).alias("is_new"), "is_text", F.col("file_size").alias("bytes")))
    last = messages.join(sources.select("source_id", "source_type"), "source_id").groupBy("source_id", "source_type").agg(F.max("id").alias("last"))
    old = store.read("source_state", SOURCE_STATE).select("source_id", "state")
    took = F.lit(max(time.time() - began, 1e-3))
    run = F.struct(
        F.lit(now).alias("timestamp"), *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("files_ingested", "bytes_ingested")), took.alias("duration_seconds"),
        *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("skipped_files", "text_items", "media_items")), F.col("avg_bytes").cast("double").alias("avg_bytes"), (F.coalesce("bytes_ingested", F.lit(0)) / took).alias("bytes_per_second"),
    )
    j = last.join(per, "source_id", "left").join(old, "source_id", "left")
    total = F.coalesce("state.stats.total_files", F.lit(0)) + F.coalesce("files_ingested", F.lit(0))
    state = F.struct(F.greatest("last", F.coalesce("state.offset", F.lit(0))).alias("offset"), F.struct(total.alias("total_files"), run.alias("last_run")).alias("stats"))
    changes = j.select("source_id", "source_type", state.alias("state"), F.lit(int(now)).cast("bigint").alias("updated_at"))
    sums = upsert(store.read("source_state", SOURCE_STATE), changes, ["source_id"], ["updated_at"], keep=["source_type"])
    skips = judged.groupBy("source_id", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n")).select(F.lit(n).cast("bigint").alias("run"), "source_id", "reason", "n")
    store.together(lambda s: s.replace("source_state", sums), lambda s: s.append("skips", skips))


def run(spark: SparkSession, messages: DataFrame, store_path: str, checkpoint: str, then: Callable[[Store, DataFrame, int], None] | None = None, timeout: float | None = None, batch: Callable[[Store, DataFrame, str], DataFrame] | None = None) -> None:
    """Reads what is there and stops, or is stopped after `timeout` seconds. batch(store, messages, tag) records a batch of
    messages and returns the files that it added; then(store, new files, batch id) goes on with them."""
    store = Store(spark, store_path)
    batch = batch or (lambda store, df, tag: record(store, items(df), tag))

    def each(df: DataFrame, batch_id: int) -> None:
        new = batch(store, df, f"batch-{batch_id}")
        if then:
            then(store, new, batch_id)

    query = messages.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    if not query.awaitTermination(timeout) and timeout is not None:
        query.stop()
