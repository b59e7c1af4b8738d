"""Transforming files to records, and building a route's artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.naming import ZIP_FORMATS
from ..functions.text import sha256, to_base64
from ..functions.uris import decode, is_uri_line
from ..operators.keyed import latest_per_key
from ..sources.files import blob_lookup
from ..sources.sinks import bundles
from .formats import artifact_lines, names, parse, with_format


def judge(pending: DataFrame, blobs: DataFrame, sources: DataFrame) -> DataFrame:
    """pending files (raw_hash, source_id, filename) with their content of blobs, fmt, status and error_msg; sources:
    include_formats. One file failing doesn't touch the others."""
    files = blob_lookup(pending.select("raw_hash", "source_id", "filename"), blobs, "raw_hash")
    files = with_format(files).join(sources.select("source_id", "include_formats"), "source_id", "left")
    allowed = F.col("include_formats").isNull() | F.array_contains("include_formats", F.col("fmt")) | F.array_contains("include_formats", "all")
    error = (
        F.when(F.col("content").isNull(), "Raw data missing")
        .when(~allowed, F.concat(F.lit("Format "), "fmt", F.lit(" not allowed")))
        .when(~F.col("fmt").isin(names()), F.concat(F.lit("No handler for "), "fmt"))
    )
    status = F.when(F.col("content").isNull(), "failed").when(~allowed, "ignored").when(error.isNotNull(), "failed").otherwise("processed")
    return files.withColumns({"status": status, "error_msg": error})


def transform(pending: DataFrame, blobs: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of pending files as by judge(), and their statuses: raw_hash, source_id, fmt, status, error_msg."""
    return told(judge(pending, blobs, sources))


def told(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and statuses of what judge() returns, which is read once for each format."""
    return parse(judged.where("status = 'processed'")), judged.select("raw_hash", "source_id", "fmt", "status", "error_msg")


def for_build(records: DataFrame, files: DataFrame, types: Column, sources: Column, cutoff: Column | None = None) -> DataFrame:
    """Active records of the types, from files of the sources with ids above the cutoff; the latest of each
    (record_type, unique_hash), with file_id. The filters reach both scans; the join fans out, the aggregate undoes it."""
    f = files.where(sources)
    if cutoff is not None:
        f = f.where(F.col("id") > cutoff)
    f = f.groupBy("raw_hash").agg(F.max("id").alias("file_id")).withColumnRenamed("raw_hash", "source_file_hash")
    r = records.where(types & F.coalesce(F.col("is_active"), F.lit(True)))
    return latest_per_key(r.join(f, "source_file_hash"), ["record_type", "unique_hash"], ["id", "file_id"])


def build(records: DataFrame, blobs: DataFrame) -> DataFrame:
    """records: route, format, id, pos, data. One row for each artifact: route, format, unique_id, artifact_hash, data, n.

    An artifact is one file, so its lines meet in one row; lines are distinct and numbered before, on the cluster.
    """
    text = records.where(~F.col("format").isin(ZIP_FORMATS))
    lines = artifact_lines(text.select("route", "format", "id", "pos", F.col("data.line").alias("line")).where("line is not null and line <> ''"))
    rows = F.array_sort(F.collect_list(F.struct("at", "line")))
    joined = F.array_join(F.transform(rows, lambda r: r["line"]), "\n")
    plain = lines.groupBy("route", "format").agg(joined.alias("text"), F.count("*").alias("n"))
    plain = plain.select("route", "format", F.encode("text", "UTF-8").alias("data"), "n")
    zips = records.where(F.col("format").isin(ZIP_FORMATS)).select("route", "format", F.col("id").alias("pos"), F.col("data.filename").alias("filename"), F.col("data.blob_hash").alias("blob_hash"))
    both = plain.unionByName(bundles(blob_lookup(zips, blobs)))
    digest = sha256(F.col("data"))
    return both.select("route", "format", F.concat_ws(":", "route", "format").alias("unique_id"), digest.alias("artifact_hash"), "data", "n")


def derived(artifacts: DataFrame) -> DataFrame:
    """The decoded document and the base64 subscription of URI artifacts."""
    uris = artifacts.where(F.col("format").isin("npvt", "npvtsub") & (F.octet_length("data") > 0)).withColumn("text", F.decode("data", "UTF-8"))
    sub = uris.select("route", F.concat("format", F.lit(".b64sub")).alias("format"), F.concat("artifact_hash", F.lit("_b64")).alias("artifact_hash"), F.encode(to_base64(F.trim("text")), "UTF-8").alias("data"), "n")
    entry = uris.select("route", "format", "artifact_hash", "n", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(is_uri_line(F.col("line"))).withColumn("e", decode(F.col("line")))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.to_json("e").alias("j")))), lambda r: r["j"])
    doc = entry.groupBy("route", "format", "artifact_hash", "n").agg(entries.alias("j"), F.count("*").alias("total"), F.collect_list("e.protocol").alias("p"))
    kinds = F.array_distinct("p")
    counts = F.map_from_entries(F.transform(kinds, lambda k: F.struct(k, F.size(F.filter("p", lambda x: x == k)).alias("v"))))
    text = F.concat(F.lit('{"total":'), F.col("total").cast("string"), F.lit(',"protocols":'), F.to_json(counts), F.lit(',"entries":['), F.array_join("j", ","), F.lit("]}"))
    docs = doc.select("route", F.concat("format", F.lit(".decoded.json")).alias("format"), F.concat("artifact_hash", F.lit("_dec")).alias("artifact_hash"), F.encode(text, "UTF-8").alias("data"), "n")
    out = docs.unionByName(sub)
    return out.select("route", "format", F.concat_ws(":", "route", "format").alias("unique_id"), "artifact_hash", "data", "n")
