"""Lines, normalisation, lenient decoding and hashes."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import arrow_udf

#: Line ends: CR LF, LF, CR, VT, FF, FS, GS, RS, NEL, LS, PS.
LINE_END = "\\r\\n|[\\n\\r\\u000b\\u000c\\u001c\\u001d\\u001e\\u0085\\u2028\\u2029]"


def split_lines(text: Column) -> Column:
    """The lines of a text; no empty one after a last line end."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip(text: Column) -> Column:
    """Without Unicode white space at either end; F.trim takes spaces only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


@arrow_udf(T.StringType())
def nfkc(text: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in text.to_pylist()], pa.string())


def normalize(text: Column) -> Column:
    """NFKC and stripped; plain ASCII skips the Arrow function."""
    return strip(F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(nfkc(text)))


@arrow_udf(T.StringType())
def _valid_nfkc(data: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unicodedata.normalize("NFKC", x.decode("utf-8", "ignore")) for x in data.to_pylist()], pa.string())


def normal_text(data: Column) -> Column:
    """normalize(utf8_ignore(data)) by one Arrow function."""
    plain = F.is_valid_utf8(data.cast("string")) & data.cast("string").rlike(r"^[\x00-\x7F]*$")
    return strip(F.when(plain, data.cast("string")).otherwise(_valid_nfkc(F.when(~plain, data))))


@arrow_udf(T.StringType())
def _valid_parts(data: pa.Array) -> pa.Array:
    return pa.array([None if x is None else x.decode("utf-8", "ignore") for x in data.to_pylist()], pa.string())


def utf8_ignore(data: Column) -> Column:
    """Bytes as text, invalid ones dropped; only these go through Python."""
    valid = F.is_valid_utf8(data.cast("string"))
    return F.when(valid, data.cast("string")).otherwise(_valid_parts(F.when(~valid, data)))


#: Value of each character of the alphabet, in both of its spellings.
_VALUES = {ord(c): i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")} | {ord("-"): 62, ord("_"): 63}


def lenient_base64(data: str, url_safe: bool = True) -> str | None:
    """What the characters of the alphabet say, six bits each, up to where padding completes a group of four; other
    characters don't count, and padding that lacks at the end of the data is supplied. None where one character of a
    group is left over, or padding is short of what the length needs."""
    bits = size = held = pads = 0
    out = bytearray()
    padded = data + "=" * (-len(data) % 4)
    for c in map(ord, padded):
        if c == 61:
            pads += held % 4 >= 2
            if held % 4 >= 2 and held % 4 + pads >= 4:
                break
            continue
        value = _VALUES.get(c) if url_safe or c not in (45, 95) else None
        if value is None:
            continue
        pads, held = 0, held + 1
        bits, size = bits << 6 | value, size + 6
        if size >= 8:
            size -= 8
            out.append(bits >> size)
            bits &= (1 << size) - 1
    if held % 4 == 1 or held % 4 and held % 4 + pads < 4:
        return None
    return out.decode("utf-8", "ignore")


@arrow_udf(T.StringType())
def from_base64(text: pa.Array) -> pa.Array:
    return pa.array([None if x is None else lenient_base64(x) for x in text.to_pylist()], pa.string())


@arrow_udf(T.StringType())
def decoded_list(lines: pa.Array) -> pa.Array:
    """Each line decoded, or as it is where it can't be; line ends inside become blanks."""
    one = lambda v: v if (x := lenient_base64(v)) is None else x.replace("\n", " ")
    return pa.array([None if x is None else "\n".join(map(one, x.split("\n"))) for x in lines.to_pylist()], pa.string())


def to_base64(text: Column) -> Column:
    """Without line breaks, whatever spark.sql.chunkBase64String.enabled says."""
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"[\r\n]", "")


def sha256(data: Column) -> Column:
    return F.sha2(data.cast("binary"), 256)


def short_md5(data: Column) -> Column:
    return F.substring(F.md5(data.cast("binary")), 1, 8)


def kept_line(line: Column) -> Column:
    """Neither blank nor a comment, once normalised."""
    return (line != "") & ~line.startswith("#")
