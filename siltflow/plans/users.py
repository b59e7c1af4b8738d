"""Users of the read side: registering, muting, preferences, and the files that a request finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.naming import matches_format
from ..operators.keyed import upsert
from ..sources.files import recent


def register(users: DataFrame, seen: DataFrame) -> DataFrame:
    """users with those of seen (user_id, chat_id, username, registered_at): new ones with defaults, known ones with a new chat and name."""
    full = seen.select("user_id", "chat_id", "username", "registered_at", F.lit(False).alias("muted"), F.lit(None).cast("double").alias("last_delivered_at"), F.lit("npvt").alias("default_format"))
    return upsert(users, full, ["user_id"], ["registered_at"], keep=["registered_at", "muted", "last_delivered_at", "default_format"])


def update(users: DataFrame, user_id: str, **values) -> DataFrame:
    """users with muted, default_format or last_delivered_at set for one of them."""
    mine = F.col("user_id") == user_id
    return users.withColumns({k: F.when(mine, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})


def files_for(outputs: DataFrame, archive: DataFrame, fmt: str, now: Column, days: int = 4) -> DataFrame:
    """The outputs of a format, or, where there are none, the archived ones of the last days, newest first."""
    mine = lambda df: df.where((F.col("size") > 0) & matches_format(F.col("name"), fmt))
    return mine(outputs) if mine(outputs).head(1) else recent(mine(archive), now, days)


def latest(outputs: DataFrame, n: int = 10) -> DataFrame:
    """The newest outputs that have something in them."""
    return outputs.where("size > 0").select("name", "size", "modified").orderBy(F.desc("modified"), "name").limit(n)


def info(users: DataFrame, user_id: str) -> DataFrame:
    """What a user is told about their own settings."""
    asked = users.where(F.col("user_id") == user_id)
    when = F.date_format(F.timestamp_seconds("last_delivered_at"), "yyyy-MM-dd HH:mm:ss")
    return asked.select("user_id", "username", "default_format", F.coalesce("muted", F.lit(False)).alias("muted"), F.date_format(F.timestamp_seconds("registered_at"), "yyyy-MM-dd HH:mm:ss").alias("registered"), F.coalesce(when, F.lit("never")).alias("last_received"))


def formats_there(outputs: DataFrame, formats: tuple[str, ...]) -> DataFrame:
    """format and the number of its non-empty outputs, for formats that have any."""
    rows = outputs.where("size > 0").select(F.explode(F.array_compact(F.array(*(F.when(matches_format(F.col("name"), f), F.lit(f)) for f in formats)))).alias("format"))
    return rows.groupBy("format").agg(F.count("*").alias("n"))
