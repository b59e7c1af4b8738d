"""The all-time list of URIs, the site's catalog, and a client's test configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.naming import human_size
from ..functions.text import short_md5, to_base64
from ..functions.uris import outbound, scheme_of, strip_remark, with_remark
from ..operators.keyed import first_seen, numbered


def remember(manifest: DataFrame, records: DataFrame, now: Column) -> DataFrame:
    """manifest (uri, first_seen) with the URIs of records (line) that it lacks."""
    line = F.trim("line")
    found = records.select(line.alias("line")).where(F.contains("line", F.lit("://"))).select(strip_remark(F.col("line")).alias("uri"))
    return first_seen(manifest, found, now)


def listed(manifest: DataFrame) -> DataFrame:
    """pos, uri with its number as remark, first_seen: newest first, then by uri; numbers count within a scheme in that order."""
    rows = manifest.withColumns({"scheme": scheme_of(F.col("uri")), "back": -F.col("first_seen")})
    rows = numbered(rows, ["scheme"], ["back", "uri"])
    return rows.select(F.struct("back", "uri").alias("pos"), with_remark(F.col("uri"), F.concat_ws("-", "scheme", F.col("n").cast("string"))).alias("uri"), "first_seen")


def history_files(manifest: DataFrame, now: Column) -> DataFrame:
    """name, data of the all-time outputs: a text file with a heading, JSON, and base64. Each is one file, so one row."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "uri", "first_seen")))
    one = listed(manifest).agg(rows.alias("rows")).withColumn("stamp", F.date_format(now, "yyyy-MM-dd HH:mm:ss 'UTC'"))
    uris = F.array_join(F.transform("rows", lambda r: r["uri"]), "\n")
    n = F.size("rows").cast("string")
    head = F.concat(F.lit("# proxy list — "), "stamp", F.lit("\n# All-time cumulative history — "), n, F.lit(" unique URIs\n# One proxy URI per line\n\n"))
    doc = F.struct(F.col("stamp").alias("_generated"), F.lit("all_time_cumulative").alias("_scope"), F.size("rows").alias("_count"), F.transform("rows", lambda r: F.struct(r["uri"].alias("uri"), r["first_seen"].alias("first_seen"))).alias("proxies"))
    files = F.array(
        F.struct(F.lit("proxies.txt").alias("name"), F.concat(head, uris, F.lit("\n")).alias("text")),
        F.struct(F.lit("proxies.json").alias("name"), F.to_json(doc).alias("text")),
        F.struct(F.lit("proxies_b64sub.txt").alias("name"), F.concat(to_base64(uris), F.lit("\n")).alias("text")),
    )
    return one.where(F.size("rows") > 0).select(F.explode(files).alias("f")).select("f.name", F.encode("f.text", "UTF-8").alias("data"))


def catalog(files: DataFrame, tag: str) -> DataFrame:
    """files: name, modified, size, content. One entry for each file of an output folder."""
    ext = F.upper(F.regexp_extract("name", r"\.([^.]+)$", 1))
    kind = F.when(ext == "", "UNKNOWN").otherwise(ext)
    return files.select(F.col("name").alias("filename"), F.concat(F.lit(f"artifacts/{tag}/"), "name").alias("path"), "size", human_size(F.col("size")).alias("size_str"), kind.alias("type"), kind.alias("ext"), F.array(F.lit(tag)).alias("tags"), F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss").alias("last_modified"), short_md5(F.col("content")).alias("hash"))


def catalog_json(entries: DataFrame, now: Column) -> DataFrame:
    """json: the catalog as one document, a row of a few hundred bytes for each output file."""
    total = F.coalesce(F.sum("size"), F.lit(0))
    kb = F.regexp_replace(F.format_number(total / 1024, 1), ",", "")
    text = F.when(total < 1 << 20, F.concat(kb, F.lit(" KB"))).otherwise(human_size(total))
    doc = F.struct(F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"), F.count("*").alias("total_files"), total.alias("total_size"), text.alias("total_size_str"), F.array_sort(F.collect_list(F.struct(*entries.columns))).alias("files"))
    return entries.agg(F.to_json(doc).alias("json"))


def client_config(entries: DataFrame) -> DataFrame:
    """entries: e (decoded). config: a client's configuration with the decoded vmess entries as outbounds."""
    vmess = entries.where("e.protocol = 'vmess' and e.decoded is not null").select(outbound(F.col("e")).alias("o"))
    inbound = F.array(F.struct(F.lit(1080).alias("port"), F.lit("socks").alias("protocol"), F.struct(F.lit("noauth").alias("auth")).alias("settings")))
    return vmess.agg(F.to_json(F.struct(inbound.alias("inbounds"), F.collect_list("o").alias("outbounds"))).alias("config"))
