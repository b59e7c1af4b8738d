"""Sinks: content-addressed blobs, artifacts, exports, bundles, rejects."""

from __future__ import annotations

import io
import os
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.keyed import collision_names, unseen


def write_atomic(path: str, data: bytes) -> None:
    """The whole file or none: written beside, flushed, renamed."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = f"{path}.{os.getpid()}.part"
    try:
        with open(part, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.unlink(part)


def save_blobs(items: DataFrame, blobs: DataFrame) -> DataFrame:
    """The blobs to append (raw_hash, content): one for each content that blobs lacks."""
    new = items.select(F.sha2("data", 256).alias("raw_hash"), F.col("data").alias("content"))
    return unseen(new.groupBy("raw_hash").agg(F.first("content").alias("content")), blobs, ["raw_hash"])


def blob_path(raw_hash: Column) -> Column:
    return F.concat_ws("/", F.lit("raw"), F.substring(raw_hash, 1, 2), raw_hash)


def artifact_path(route: Column, fmt: Column, digest: Column) -> Column:
    return F.concat(F.lit("dist/internal/"), route, F.lit("/"), digest, F.lit("."), fmt)


def archive_name(route: Column, epoch: Column, fmt: Column) -> Column:
    return F.concat(route, F.lit("_"), epoch.cast("bigint").cast("string"), F.lit("."), fmt)


#: A fixed time for ZIP entries, so that equal contents give equal archives.
ZIP_TIME = (1980, 1, 1, 0, 0, 0)


def bundle(entries: list[tuple[str, bytes]]) -> bytes:
    """A ZIP of (entry, content) in order."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for entry, content in entries:
            z.writestr(zipfile.ZipInfo(entry, ZIP_TIME), content, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def bundles(records: DataFrame) -> DataFrame:
    """records: route, format, pos, filename, content; missing contents are left out. One archive for each route and
    format: an artifact is one file, so its group is what one task holds; entries are named before, on the cluster."""
    there = records.select("route", "format", "pos", F.coalesce("filename", F.lit("file")).alias("filename"), "content").where("content is not null")
    named = collision_names(there.drop("content"), ["route", "format"], "filename", ["pos", "filename"])
    rows = there.join(named, ["route", "format", "pos", "filename"])

    def build(key: tuple[str, str], pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["pos", "filename"], kind="stable")
        return pd.DataFrame({"route": [key[0]], "format": [key[1]], "data": [bundle(list(zip(rows["entry"], rows["content"])))], "n": [len(rows)]})

    return rows.groupBy("route", "format").applyInPandas(build, "route string, format string, data binary, n bigint")


def rejects(items: DataFrame, reason: Column, now: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Names and contents of rejected items, and the columns to keep."""
    from ..functions.naming import sanitized

    name = F.concat_ws("_", now.cast("bigint").cast("string"), sanitized(F.col("source_id")), F.substring(sanitized(reason), 1, 30))
    return items.select(*keep, F.concat(name, F.lit(".dat")).alias("name"), "data")


def export(files: DataFrame, folder: str, copies: str | None = None) -> int:
    """Writes (name, data) rows as files of a folder, one at a time; names are a run's outputs, few by nature. copies: the
    folder for second files of the same data, named by copy."""
    n = 0
    for row in files.select("name", *(["copy"] if copies else []), "data").toLocalIterator():
        write_atomic(os.path.join(folder, row["name"]), bytes(row["data"]))
        if copies:
            write_atomic(os.path.join(copies, row["copy"]), bytes(row["data"]))
        n += 1
    return n
