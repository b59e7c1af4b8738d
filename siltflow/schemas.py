"""Schemas of the state tables and of what flows between the stages."""

from __future__ import annotations

from pyspark.sql import types as T

_SIMPLE = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "timestamp": T.TimestampType()}


def struct(text: str, **nested: T.DataType) -> T.StructType:
    """'name type, ...' as a StructType, without a session; nested types by name."""
    pairs = [x.split() for x in text.split(",")]
    return T.StructType([T.StructField(n, nested.get(t) or _SIMPLE[t]) for n, t in pairs])


LAST_RUN = struct("timestamp double, files_ingested bigint, bytes_ingested bigint, duration_seconds double, skipped_files bigint, text_items bigint, media_items bigint, avg_bytes double, bytes_per_second double")
STATS = struct("total_files bigint, last_run run", run=LAST_RUN)
SOURCE_STATE = struct("source_id string, source_type string, state state, updated_at bigint", state=struct("offset bigint, stats stats", stats=STATS))
SEEN_FILES = struct("id bigint, source_id string, external_id string, raw_hash string, ingested_at timestamp, file_size bigint, filename string, metadata_json string, status string, error_msg string")
DATA = struct("line string, filename string, blob_hash string, size bigint")
RECORDS = struct("id bigint, source_file_hash string, record_type string, unique_hash string, data data, created_at timestamp, is_active boolean", data=DATA)
PUBLISHED = struct("id bigint, unique_id string, artifact_hash string, published_at timestamp, metadata_json string")
USERS = struct("user_id string, chat_id string, username string, registered_at double, muted boolean, last_delivered_at double, default_format string")
MESSAGES = struct("source_id string, id bigint, ts double, chat_id string, text string, caption string, file_name string, file_ext string, file_size bigint, data binary, photo boolean, video boolean, animation boolean, gif boolean, sticker boolean, voice boolean, audio boolean, video_note boolean")
ITEMS = struct("source_id string, external_id string, data binary, filename string, ts double, is_text boolean")
BLOBS = struct("raw_hash string, content binary")
SKIPS = struct("run bigint, source_id string, reason string, n bigint")
STATUS = struct("raw_hash string, source_id string, status string, error_msg string, fmt string, run bigint")
MANIFEST = struct("uri string, first_seen double")
ENTRY = struct(
    "protocol string, user string, password string, address string, port bigint, tag string, params lists, method string, ssr_protocol string, "
    "obfs string, extra map, decoded string, decoded_text string, error string, raw string",
    lists=T.MapType(T.StringType(), T.ArrayType(T.StringType())), map=T.MapType(T.StringType(), T.StringType()),
)
STATUSES = ("pending", "processed", "failed", "ignored")


def migrated(df, schema: T.StructType):
    """df with the schema's columns; those that an older table lacks are null."""
    from pyspark.sql import functions as F

    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))
