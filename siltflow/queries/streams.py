"""Queries that run streams to their end and return what they left."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..streaming.ingest import new_items


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; a local session that names none gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names the folder that driver and executors share")
    return (base or tempfile.mkdtemp(prefix="siltflow-")).rstrip("/")


def _run(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Drains the stream into Parquet in the shared folder."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_ingest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys that a stream of events lets through once."""
    items = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("source_id"), F.col("event_type").alias("external_id"))
    return _run(spark, new_items(items))


def stream_dedup_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with keys kept for a bounded time only."""
    items = _events(spark, sf_dir).select(F.col("event_id").cast("string").alias("external_id"), F.col("user_id").cast("string").alias("source_id"), "ts")
    return _run(spark, new_items(items, "40 days")).select("source_id", "external_id")


QUERIES = {f.__name__: f for f in (stream_ingest_dedup, stream_dedup_within)}
ORACLES = {
    "stream_ingest_dedup": "SELECT DISTINCT user_id::VARCHAR AS source_id, event_type AS external_id FROM events",
    "stream_dedup_within": "SELECT user_id::VARCHAR AS source_id, event_id::VARCHAR AS external_id FROM events",
}
