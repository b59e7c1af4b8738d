"""One run from messages to outputs: ingest, transform, build each route's delta, export, publish what changed, remember
and tidy up. Every step that changes state is one transaction of the store; a step that fails is done by the next run."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.naming import output_name
from ..functions.uris import vmess_entry
from ..operators.keyed import prunable, stale, upsert, waiting
from ..operators.messages import Windows, distinct_channels, judged_items
from ..schemas import BLOBS, MANIFEST, PUBLISHED, RECORDS, SEEN_FILES, SOURCE_STATE, STATUS, USERS
from ..sources.files import Store, dated, expired, listing, table
from ..sources.messages import stream
from ..sources.sinks import archive_name, export, write_atomic
from ..streaming.ingest import added, record, record_sources, run as ingest, with_ids
from . import config, history
from .formats import URI_FORMATS
from .publish import auto_delivery, deliver, delivery, publish, publishable
from .route import build, derived, for_build, judge, told


@dataclass(frozen=True)
class Options:
    """delta: artifacts hold what this run processed, as opposed to all. now: seconds, the clock if None. keep_days: of the
    archive. remove_stale: delete outputs of routes that this run didn't make. batch_files, transform_files: bounds of a
    batch; timeout: seconds for reading, after which what was read is still built."""

    delta: bool = True
    now: float | None = None
    windows: Windows = field(default_factory=Windows)
    keep_days: int = 4
    remove_stale: bool = True
    batch_files: int | None = None
    transform_files: int | None = None
    timeout: float | None = None
    feed_format: str = "json"
    tag: str = "latest"


def ingest_batch(store: Store, messages: DataFrame, tag: str, sources: DataFrame, now: float, windows: Windows) -> DataFrame:
    """Filters a batch of messages and records its items, each source's offset and what was dropped, in one transaction."""
    if (done := store.tagged(tag)) is not None:
        return added(store, done)
    owners = distinct_channels(sources)
    owners = table(store.spark, owners.collect(), owners.schema)  # a row for each source
    offsets = store.read("source_state", SOURCE_STATE).select("source_id", F.col("state.offset").alias("offset"))
    with store.transaction(tag) as n, store.kept(judged_items(messages, owners, offsets, F.lit(now), windows)) as judged:
        record(store, judged.where("reason is null"))
        record_sources(store, judged, messages, owners, n, now)
    return added(store, n)


def pending(store: Store, limit: int | None = None) -> DataFrame:
    """Files without a status yet, the first ones by id; statuses are a table of their own that rows are only added to."""
    return waiting(store.read("seen_files", SEEN_FILES).drop("status", "error_msg"), store.read("status", STATUS), ["raw_hash", "source_id"], limit)


def transform_pending(store: Store, sources: DataFrame, run: int, limit: int | None = None) -> int:
    """Records and statuses of pending files, batch after batch if there is a limit; how many batches there were. Content
    that a source has under several names counts by the first of them in code point order."""
    blobs, n = store.read("blobs", BLOBS), 0
    while True:
        files = pending(store, limit).groupBy("raw_hash", "source_id").agg(F.min("filename").alias("filename"))
        with store.kept(judge(files, blobs, sources)) as judged:
            if not judged.select("raw_hash").head(1):
                return n
            records, status = told(judged)

            def add_records(store: Store) -> None:
                with store.kept(records) as kept:
                    rows = with_ids(kept, ["raw_hash", "record_type", "pos"], store.open, by=["raw_hash"])
                    store.append("records", rows.select("id", F.col("raw_hash").alias("source_file_hash"), "record_type", "unique_hash", "data", F.current_timestamp().alias("created_at"), F.lit(True).alias("is_active")))

            with store.transaction():
                store.together(add_records, lambda s: s.append("status", status.withColumn("run", F.lit(run).cast("bigint")).select(*STATUS.fieldNames())))
        if limit is None:
            return 1
        n += 1


def route_rows(store: Store, route: config.Route, run: int | None) -> DataFrame:
    """What build() takes for a route: the records of the files that a run processed, or of all."""
    files = store.read("seen_files", SEEN_FILES)
    if run is not None:
        files = files.join(store.read("status", STATUS).where(F.col("run") == run), ["raw_hash", "source_id"], "left_semi")
    rows = for_build(store.read("records", RECORDS), files, F.col("record_type").isin(*route.formats), F.col("source_id").isin(*route.from_sources))
    return rows.select(F.lit(route.name).alias("route"), F.col("record_type").alias("format"), F.col("file_id").alias("id"), F.col("id").alias("pos"), "data")


@contextmanager
def built_routes(store: Store, routes: list[config.Route], run: int | None) -> Iterator[DataFrame]:
    """All artifacts of the routes. Each step is written once: artifacts are read for every output that is made of them."""
    rows = reduce(DataFrame.unionByName, (route_rows(store, r, run) for r in routes))
    with store.kept(rows) as rows, store.kept(build(rows, store.read("blobs", BLOBS))) as plain, store.kept(plain.unionByName(derived(plain)).where(F.octet_length("data") > 0)) as built:
        yield built


def export_run(spark: SparkSession, built: DataFrame, routes: list[str], data: str, now: float, options: Options) -> None:
    """Writes the outputs and a dated copy of each, removes those of the routes that this run didn't make, and old copies."""
    named = built.select(output_name(F.col("route"), F.col("format")).alias("name"), archive_name(F.col("route"), F.lit(int(now)), F.col("format")).alias("copy"), "data")
    export(named, f"{data}/output", f"{data}/archive")
    if options.remove_stale:
        there = table(spark, [(n,) for n in sorted(os.listdir(f"{data}/output"))] if os.path.isdir(f"{data}/output") else [], "name string")
        remove(stale(there, named, table(spark, [(r,) for r in routes], "route string")), f"{data}/output")
    if os.path.isdir(f"{data}/archive") and os.listdir(f"{data}/archive"):
        remove(expired(dated(listing(spark, f"{data}/archive")), F.timestamp_seconds(F.lit(now)), options.keep_days), f"{data}/archive")


def remove(files: DataFrame, folder: str) -> None:
    """Deletes files (name) of an output folder; a run's outputs are few."""
    for row in files.select("name").toLocalIterator():
        os.unlink(os.path.join(folder, row["name"]))


def remember_run(store: Store, spark: SparkSession, run: int, data: str, now: float) -> None:
    """Adds the run's URIs to the all-time list and writes its files."""
    done = store.read("status", STATUS).where((F.col("run") == run) & (F.col("status") == "processed")).select(F.col("raw_hash").alias("source_file_hash")).distinct()
    lines = store.read("records", RECORDS).where(F.col("record_type").isin(*URI_FORMATS)).join(done, "source_file_hash", "left_semi").select(F.col("data.line").alias("line"))
    store.replace("manifest", history.remember(store.read("manifest", MANIFEST), lines, F.lit(now)))
    export(history.history_files(store.read("manifest", MANIFEST), F.timestamp_seconds(F.lit(now))), f"{data}/history")


def describe(spark: SparkSession, data: str, now: float, tag: str) -> None:
    """Writes the catalog of the outputs, and a client's configuration of the URIs among them."""
    if not os.path.isdir(f"{data}/output") or not os.listdir(f"{data}/output"):
        return
    files = listing(spark, f"{data}/output")
    doc = history.catalog_json(history.catalog(files, tag), F.timestamp_seconds(F.lit(now))).first()["json"]
    write_atomic(f"{data}/catalog.json", doc.encode())
    lines = files.where(F.col("name").endswith(".npvt")).select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line"))
    entries = lines.where(F.col("line").startswith("vmess://")).select(vmess_entry(F.col("line")).alias("e"))
    write_atomic(f"{data}/client.json", history.client_config(entries).first()["config"].encode())


def tidy_blobs(store: Store) -> None:
    """Drops the contents of files that are all told and that no record needs."""
    gone = removable(store)
    if gone.head(1):
        store.replace("blobs", store.read("blobs", BLOBS).join(gone, "raw_hash", "left_anti"))


def tidy(store: Store) -> None:
    """Joins small folders."""
    for name, schema in (("blobs", BLOBS), ("seen_files", SEEN_FILES), ("status", STATUS), ("records", RECORDS), ("published", PUBLISHED)):
        store.compact(name, schema)


def removable(store: Store) -> DataFrame:
    """Blobs whose files are all told and that no record needs, nor a bundle's record refers to."""
    done = store.read("status", STATUS).where("status <> 'pending'").select("raw_hash")
    return prunable(done, store.read("records", RECORDS), pending(store)).join(store.read("blobs", BLOBS).select("raw_hash"), "raw_hash", "left_semi")


def once(spark: SparkSession, settings: config.Config, feed: str, data: str, send: Callable[[dict], bool] | None = None, options: Options = Options(), give: Callable[[dict], bool] | None = None) -> int:
    """Everything that is new in the feed; the run's number. send: publishes an artifact to a destination; give: an output
    to a user. Without new files nothing is built, and the outputs stay."""
    tables, store = config.tables(spark, settings), Store(spark, f"{data}/state")
    store.drop("_scratch")  # of a run that was broken off
    run = max(store.commits(), default=-1) + 1
    now = time.time() if options.now is None else options.now
    batch = lambda s, df, tag: ingest_batch(s, df, tag, tables["sources"], now, options.windows)
    ingest(spark, stream(spark, feed, options.feed_format, options.batch_files), store.root, f"{data}/checkpoint", timeout=options.timeout, batch=batch)
    if not transform_pending(store, tables["sources"], run, options.transform_files):
        return run
    store.together(
        lambda s: build_and_send(s, settings, run, data, now, send, give, options),
        lambda s: remember_run(s, spark, run, data, now),
        tidy_blobs,
    )
    tidy(store)
    return run


def build_and_send(store: Store, settings: config.Config, run: int, data: str, now: float, send: Callable[[dict], bool] | None, give: Callable[[dict], bool] | None, options: Options) -> None:
    """A run's outputs, while what changed is published; then their catalog, while they are given to the users."""
    if routes := settings.routes:
        with built_routes(store, routes, run if options.delta else None) as built:
            store.together(lambda s: export_run(s.spark, built, [r.name for r in routes], data, now, options), lambda s: publish_run(s, built, settings, now, send))
    store.together(lambda s: describe(s.spark, data, now, options.tag), lambda s: give_outputs(s, data, now, give))


def publish_run(store: Store, built: DataFrame, settings: config.Config, now: float, send: Callable[[dict], bool] | None) -> None:
    """Sends the artifacts that changed since they were published to their routes' destinations."""
    spark = store.spark
    to = [(r.name, d.chat_id, d.token, d.caption_template) for r in settings.routes for d in r.destinations]
    if send and to:
        plan = delivery(publishable(built, store.read("published", PUBLISHED)), table(spark, to, "route string, chat_id string, token string, caption_template string"), F.timestamp_seconds(F.lit(now)))
        with store.transaction() as n:
            marked = publish(plan, send, n * (1 << 33), now)
            rows = table(spark, marked, "id long, unique_id string, artifact_hash string, published_at double")
            store.append("published", rows.select("id", "unique_id", "artifact_hash", F.timestamp_seconds("published_at").alias("published_at"), F.lit(None).cast("string").alias("metadata_json")))


def give_outputs(store: Store, data: str, now: float, give: Callable[[dict], bool] | None) -> None:
    users = store.read("users", USERS)
    if give and os.path.isdir(f"{data}/output"):
        reached = deliver(auto_delivery(users, listing(store.spark, f"{data}/output")), give)
        changes = users.join(table(store.spark, [(u,) for u in reached], "user_id string"), "user_id", "left_semi").withColumn("last_delivered_at", F.lit(now))
        store.replace("users", upsert(users, changes, ["user_id"], ["last_delivered_at"], keep=["registered_at"]))
