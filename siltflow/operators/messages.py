"""Messages of chat sources: filters, look-back windows and projection to items."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

MOST_BYTES = 25 * 1024 * 1024
# Kinds of attachments that are dropped.
UNWANTED = ["photo", "video", "animation", "gif", "sticker", "voice", "audio", "video_note"]
BOT, USER = "telegram", "telegram_user"


@dataclass(frozen=True)
class Windows:
    """Hours back that texts and files may lie, for a fresh source and later; 0: any."""

    text_fresh: float = 2
    file_fresh: float = 48
    text_later: float = 0
    file_later: float = 0

    def hours(self, fresh: Column, is_file: Column) -> Column:
        pick = lambda a, b: F.when(is_file, F.lit(float(b))).otherwise(F.lit(float(a)))
        return F.when(fresh, pick(self.text_fresh, self.file_fresh)).otherwise(pick(self.text_later, self.file_later))


def within_window(ts: Column, now: Column, hours: Column) -> Column:
    """ts and now in seconds. Older messages are dropped for good: this is the wall clock, not a watermark."""
    return (hours == 0) | (ts >= now - hours * 3600)


def unwanted(columns: list[str], but: str | None = None) -> Column:
    """True if any of the kinds of attachments that exist as columns is present; `but` is none of them."""
    found = [F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in UNWANTED if c in columns and c != but]
    out = F.lit(False)
    for c in found:
        out = out | c
    return out


def is_apk(name: Column) -> Column:
    return F.coalesce(F.lower(name).endswith(".apk"), F.lit(False))


def skip_reason(is_file: Column, offset_ok: Column, chat_ok: Column, media: Column, recent: Column, name: Column, size: Column) -> Column:
    """Why a message is dropped, in the order of the checks; null if it is kept."""
    return (
        F.when(~offset_ok, "offset")
        .when(~chat_ok, "chat")
        .when(media, "media")
        .when(~recent, "old")
        .when(is_file & is_apk(name), "apk")
        .when(is_file & (size > MOST_BYTES), "size")
    )


def text_items(messages: DataFrame, suffix: str = "_text") -> DataFrame:
    """messages: source_id, id, ts, text, caption. One item for each message with text; a caption stands in for it."""
    body = F.coalesce(F.nullif("text", F.lit("")), F.nullif("caption", F.lit("")))
    rows = messages.withColumn("_body", body).where("_body is not null")
    ident = F.col("id").cast("string")
    return rows.select("source_id", F.concat(ident, F.lit(suffix)).alias("external_id"), F.encode("_body", "UTF-8").alias("data"), F.concat(F.lit("msg_"), ident, F.lit(".txt")).alias("filename"), "ts", F.lit(True).alias("is_text"))


def file_items(messages: DataFrame, suffix: str = "") -> DataFrame:
    """messages: source_id, id, ts, file_name, data. One item for each message with a document."""
    ident = F.col("id").cast("string")
    ext = F.coalesce("file_ext", F.lit("")) if "file_ext" in messages.columns else F.lit("")
    name = F.coalesce(F.nullif("file_name", F.lit("")), F.concat(F.lit("media_"), ident, ext))
    return messages.where("data is not null").select("source_id", F.concat(ident, F.lit(suffix)).alias("external_id"), "data", name.alias("filename"), "ts", F.lit(False).alias("is_text"))


def items(messages: DataFrame, text_suffix: str = "_text", file_suffix: str = "") -> DataFrame:
    """A message with text and a document gives two items."""
    return text_items(messages, text_suffix).unionByName(file_items(messages, file_suffix))


def is_text_item(is_text: Column, filename: Column) -> Column:
    return F.coalesce(is_text, F.lit(False)) | F.coalesce(F.lower(filename).endswith(".txt"), F.lit(False))


def distinct_channels(sources: DataFrame) -> DataFrame:
    """sources: source_id, channel_id, pos. Of sources that resolve to one channel, the first."""
    first = sources.groupBy("channel_id").agg(F.min_by("source_id", "pos").alias("source_id"))
    return sources.join(first.select("source_id"), "source_id", "left_semi")


def judged_items(messages: DataFrame, sources: DataFrame, offsets: DataFrame, now: Column, windows: Windows = Windows()) -> DataFrame:
    """Every item that a message may give, with the reason why it is dropped, or null: source_id, id, external_id, data,
    filename, ts, is_text, reason. sources: source_id, source_type, chat_id (or null: any); offsets: source_id, offset.

    The two kinds of connectors differ: bots read captions, call animations what users call gifs, judge the text beside
    a document by the window of files, and number texts, where users number documents, by a suffix. Messages of
    sources that aren't listed give nothing; `now` in seconds.
    """
    m = messages.join(sources.select("source_id", "source_type", F.col("chat_id").alias("_chat")), "source_id")
    m = m.join(offsets.select("source_id", F.col("offset").alias("_offset")), "source_id", "left")
    bot, ident, last = F.col("source_type") == BOT, F.col("id").cast("string"), F.coalesce("_offset", F.lit(0))
    has_file = F.col("data").isNotNull() | F.col("file_name").isNotNull()
    media = F.when(bot, unwanted(messages.columns, "gif")).otherwise(unwanted(messages.columns, "animation"))
    text = F.coalesce(F.nullif("text", F.lit("")), F.when(bot, F.nullif("caption", F.lit(""))))
    name = F.coalesce(F.nullif("file_name", F.lit("")), F.concat(F.lit("media_"), ident, F.coalesce("file_ext", F.lit(""))))
    apk = F.when(~bot & (F.lower("file_ext") == ".apk"), ".apk").otherwise(name)
    size = F.coalesce("file_size", F.octet_length("data").cast("bigint"), F.lit(0))

    def rows(is_file: bool, there: Column, suffix: Column, data: Column, filename: Column) -> DataFrame:
        recent = within_window(F.col("ts"), now, windows.hours(last == 0, F.lit(True) if is_file else bot & has_file))
        reason = skip_reason(F.lit(is_file), F.col("id") > last, F.col("_chat").isNull() | F.col("chat_id").eqNullSafe(F.col("_chat")), media, recent, apk, size)
        return m.where(there).select("source_id", "id", F.concat(ident, suffix).alias("external_id"), data.alias("data"), filename.alias("filename"), "ts", F.lit(not is_file).alias("is_text"), reason.alias("reason"))

    texts = rows(False, text.isNotNull(), F.when(bot, "_text").otherwise(""), F.encode(text, "UTF-8"), F.concat(F.lit("msg_"), ident, F.lit(".txt")))
    return texts.unionByName(rows(True, has_file, F.when(bot, "").otherwise("_media"), F.col("data"), name))
