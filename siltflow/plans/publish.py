"""Change-only publishing and delivery."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.naming import EMPTY_ZIP, ZIP_FORMATS, caption, matches_format, published_name
from ..operators.keyed import changed


def publishable(results: DataFrame, ledger: DataFrame) -> DataFrame:
    """Results with data, but empty ZIPs, whose hash has changed since they were last published."""
    size = F.octet_length("data")
    full = results.where((size > 0) & ~(F.col("format").isin(ZIP_FORMATS) & (size <= EMPTY_ZIP)))
    return changed(full, ledger)


def delivery(results: DataFrame, destinations: DataFrame, now: Column) -> DataFrame:
    """results with each of their route's destinations (route, chat_id, token, caption_template): name and caption."""
    j = results.join(destinations, "route")
    name = published_name(F.col("route"), F.col("format"), F.col("artifact_hash"))
    return j.withColumn("filename", name).withColumn("caption", caption(F.col("caption_template"), now, F.col("artifact_hash"), F.col("n"), F.col("format"), F.col("filename")))


def publish(plan: DataFrame, send: Callable[[dict], bool], ledger_id: int, now: float) -> list[tuple]:
    """Sends each row; ledger rows (id, unique_id, artifact_hash, published_at) of artifacts whose sends all went well.
    Destinations without a token are skipped, and an artifact with no send isn't marked. Any failure raises at the end."""
    sent: dict[tuple[str, str], list[bool]] = {}
    for row in plan.toLocalIterator():
        if row["token"]:
            sent.setdefault((row["unique_id"], row["artifact_hash"]), []).append(bool(send(row.asDict())))
    marked = [(ledger_id + i, u, h, now) for i, (u, h) in enumerate(k for k, v in sent.items() if all(v))]
    if failed := [u for (u, _), v in sent.items() if not all(v)]:
        raise RuntimeError(f"not published: {failed}; published: {marked}")
    return marked


def auto_delivery(users: DataFrame, files: DataFrame, formats: tuple[str, ...] = ("npvt", "b64sub")) -> DataFrame:
    """Every user who isn't muted with every non-empty output file of the formats. Files are a run's outputs, a few
    dozen at most, so the product is as large as the users' table times that."""
    wanted = F.lit(False)
    for f in formats:
        wanted = wanted | matches_format(F.col("name"), f)
    rows = files.where((F.col("size") > 0) & wanted)
    return users.where(~F.coalesce(F.col("muted"), F.lit(False))).crossJoin(rows.select("name", "size"))


def deliver(plan: DataFrame, give: Callable[[dict], bool]) -> list[str]:
    """Gives each user of the plan each file, one after another; the users that got at least one."""
    reached: dict[str, bool] = {}
    for row in plan.toLocalIterator():
        if give(row.asDict()):
            reached[row["user_id"]] = True
    return list(reached)
