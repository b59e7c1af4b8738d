"""Formats: how blobs become records, and records an artifact's lines. Table-driven; bundles need no parsing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.naming import ZIP_FORMATS, decide_format
from ..functions.text import from_base64, kept_line, normal_text, sha256, split_lines, strip, utf8_ignore
from ..functions.uris import ANY_SCHEME, line_uris, scheme_of, strip_remark, with_remark
from ..operators.keyed import distinct_in_order, numbered

RECORD = "raw_hash string, record_type string, unique_hash string, pos bigint, data struct<line:string,filename:string,blob_hash:string,size:bigint>"


@dataclass(frozen=True)
class Format:
    """lines: from a blob's text to an array of record lines; null for bundles, whose record is the blob itself."""

    name: str
    lines: Callable[[Column], Column] | None = None
    is_uri: bool = False


_formats: dict[str, Format] = {}


def register(f: Format) -> None:
    _formats[f.name] = f


@contextmanager
def registered(f: Format) -> Iterator[None]:
    """f as a format within the block."""
    before = _formats.get(f.name)
    register(f)
    try:
        yield
    finally:
        _formats.pop(f.name)
        if before:
            register(before)


def get(name: str) -> Format | None:
    return _formats.get(name)


def names() -> list[str]:
    return list(_formats)


def conf_lines(text: Column) -> Column:
    return F.filter(F.transform(split_lines(text), strip), kept_line)


def subscription(text: Column) -> Column:
    """The text, or what it says in base64 if that has URIs."""
    clean = strip(text)
    coded = ~F.contains(clean, F.lit("://")) & ~F.contains(clean, F.lit(" ")) & (F.length(clean) > 10)
    inner = F.when(coded, from_base64(F.when(coded, clean)))
    return F.when(F.coalesce(inner.rlike(ANY_SCHEME), F.lit(False)), inner).otherwise(text)


def uri_lines(text: Column) -> Column:
    return F.flatten(F.transform(F.filter(F.transform(split_lines(subscription(text)), strip), lambda x: x != ""), line_uris))


for _f in (Format("conf_lines", conf_lines), Format("npvt", uri_lines, True), Format("npvtsub", uri_lines, True), *(Format(z) for z in ZIP_FORMATS)):
    register(_f)


URI_FORMATS = tuple(n for n, f in _formats.items() if f.is_uri)


def with_format(files: DataFrame) -> DataFrame:
    """files: filename, content. Adds fmt."""
    preview = utf8_ignore(F.substring("content", 1, 2048))
    return files.withColumn("fmt", decide_format(F.coalesce("filename", F.lit("")), preview))


def parse(files: DataFrame, normal: bool = True) -> DataFrame:
    """files: raw_hash, filename, fmt, content; normal: texts are normalised. Records of all formats; within a blob, the first of equal records."""
    out = None
    bundles = [n for n in _formats if _formats[n].lines is None]
    text = files.where(~F.col("fmt").isin(bundles)).withColumn("text", normal_text(F.col("content")) if normal else utf8_ignore(F.col("content")))
    alike = {(f.lines, f.is_uri): [x.name for x in _formats.values() if (x.lines, x.is_uri) == (f.lines, f.is_uri)] for f in _formats.values() if f.lines}
    for (lines, is_uri), kinds in alike.items():
        rows = text.where(F.col("fmt").isin(kinds)).select("raw_hash", F.col("fmt").alias("record_type"), F.posexplode(lines(F.col("text"))).alias("pos", "line"))
        if is_uri:
            rows = rows.withColumn("line", strip_remark(F.col("line")))
        rows = distinct_in_order(rows, "line", ["pos"], ["raw_hash", "record_type"])
        nothing = F.lit(None)
        data = F.struct(F.col("line"), nothing.cast("string").alias("filename"), nothing.cast("string").alias("blob_hash"), nothing.cast("bigint").alias("size"))
        rows = rows.select("raw_hash", "record_type", sha256(F.col("line")).alias("unique_hash"), F.col("pos").cast("bigint").alias("pos"), data.alias("data"))
        out = rows if out is None else out.unionByName(rows)
    data = F.struct(F.lit(None).cast("string").alias("line"), "filename", F.col("raw_hash").alias("blob_hash"), F.octet_length("content").cast("bigint").alias("size"))
    whole = files.where(F.col("fmt").isin(bundles)).select("raw_hash", F.col("fmt").alias("record_type"), F.col("raw_hash").alias("unique_hash"), F.lit(0).cast("bigint").alias("pos"), data.alias("data"))
    return out.unionByName(whole)


def artifact_lines(records: DataFrame) -> DataFrame:
    """records: route, format, id, pos, line. Distinct lines in order; URIs numbered by scheme: route, format, at, line."""
    uri, at = F.col("format").isin(*URI_FORMATS), F.struct("id", "pos").alias("at")
    plain = distinct_in_order(records.where(~uri), "line", ["id", "pos"], ["route", "format"])
    bare = records.where(uri).withColumn("line", strip_remark(F.col("line")))
    rows = distinct_in_order(bare, "line", ["id", "pos"], ["route", "format"]).withColumn("scheme", scheme_of(F.col("line")))
    rows = numbered(rows, ["route", "format", "scheme"], ["id", "pos"])
    named = with_remark(F.col("line"), F.concat_ws("-", "scheme", F.col("n").cast("string")))
    return plain.select("route", "format", at, "line").unionByName(rows.select("route", "format", at, named.alias("line")))
