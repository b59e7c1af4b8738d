"""Format detection, file names, sizes and captions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import from_base64, strip
from .uris import ANY_SCHEME

# Extensions that name a format, the formats built as ZIP archives, and the other formats' extensions.
EXTENSIONS = {".ovpn": "ovpn", ".npv4": "npv4", ".conf": "conf_lines", ".ehi": "ehi", ".hc": "hc", ".hat": "hat", ".sip": "sip", ".nm": "nm", ".dark": "dark", ".npvtsub": "npvtsub"}
ZIP_FORMATS = ["ovpn", "npv4", "ehi", "hc", "hat", "sip", "nm", "dark", "opaque_bundle"]
TEXT_FORMATS = ["conf_lines", "npvt", "npvtsub"]
FORMATS = TEXT_FORMATS + ZIP_FORMATS
EMPTY_ZIP = 22
PREVIEW = 2048


def format_by_name(filename: Column) -> Column:
    """The format that the extension names, in any case, or null."""
    name = F.lower(filename)
    return F.coalesce(*(F.when(name.endswith(e), F.lit(f)) for e, f in EXTENSIONS.items()))


def decide_format(filename: Column, preview: Column) -> Column:
    """filename; preview: the first PREVIEW bytes as text. By extension, else by URIs inside, plain or as base64, else opaque."""
    clean = strip(preview)
    coded = ~F.contains(clean, F.lit("://")) & ~F.contains(clean, F.lit(" ")) & (F.length(clean) > 20)
    inside = F.when(coded, F.coalesce(from_base64(F.concat(F.substring(clean, 1, 512), F.lit("=="))).rlike(ANY_SCHEME), F.lit(False))).otherwise(False)
    return F.coalesce(format_by_name(filename), F.when(preview.rlike(ANY_SCHEME) | inside, "npvt"), F.lit("opaque_bundle"))


def output_name(route: Column, fmt: Column) -> Column:
    return (
        F.when(fmt.endswith(".decoded.json"), F.concat_ws("_", route, F.replace(fmt, F.lit(".decoded.json"), F.lit("")), F.lit("decoded.json")))
        .when(fmt.endswith(".b64sub"), F.concat_ws("_", route, F.replace(fmt, F.lit(".b64sub"), F.lit("")), F.lit("b64sub.txt")))
        .otherwise(F.concat_ws(".", route, fmt))
    )


def extension(fmt: Column) -> Column:
    """The extension of a published file."""
    return F.when(fmt.isin(*ZIP_FORMATS), ".zip").when(fmt == "conf_lines", ".conf").when(fmt.endswith(".decoded.json"), ".json").otherwise(".txt")


def published_name(route: Column, fmt: Column, digest: Column) -> Column:
    return F.concat(route, F.lit("_"), fmt, F.lit("_"), F.substring(digest, 1, 8), extension(fmt))


def human_size(size: Column) -> Column:
    one = lambda x: F.regexp_replace(F.format_number(x, 1), ",", "")
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024 * 1024, F.concat(one(size / 1024), F.lit(" KB"))).otherwise(F.concat(one(size / 1048576), F.lit(" MB")))


#: What names of output files may end with, or contain, for each format with a rule of its own; others have OTHER.
ENDS = {f: (f".{f}", f"_{f}.txt") for f in ("npvt", "npvtsub")} | {f: ("_b64sub.txt",) for f in ("b64sub", "npvt.b64sub", "npvtsub.b64sub")} | {f: ("_decoded.json",) for f in ("decoded.json", "npvt.decoded.json", "npvtsub.decoded.json")}
INSIDE = {f: "." + f.removeprefix("npvtsub.").removeprefix("npvt.") for f in ENDS if f.endswith(("b64sub", "decoded.json"))}
OTHER = (".{}", "_{}.txt", "_{}.json", "_{}.zip")


def matches_format(name: Column, fmt: str) -> Column:
    """Whether an output file's name is one of the format's, in either style of naming."""
    name, fmt = F.lower(name), fmt.lower()
    told = [name.endswith(e) for e in ENDS.get(fmt, [o.format(fmt) for o in OTHER])]
    if fmt in INSIDE:
        told.append(F.contains(name, F.lit(INSIDE[fmt])))
    return F.greatest(*told, F.lit(False))


def caption(template: Column, timestamp: Column, digest: Column, count: Column, fmt: Column, filename: Column) -> Column:
    """{timestamp}, {sha12}, {count}, {format} and {filename} filled in."""
    out = template
    for key, value in {"timestamp": F.date_format(timestamp, "yyyy-MM-dd HH:mm:ss"), "sha12": F.substring(digest, 1, 12), "count": count.cast("string"), "format": fmt, "filename": filename}.items():
        out = F.replace(out, F.lit("{" + key + "}"), F.coalesce(value, F.lit("?")))
    return out


def masked(token: Column) -> Column:
    return F.when(F.length(token) > 10, F.concat(F.substring(token, 1, 5), F.lit("..."), F.substring(token, -5, 5))).otherwise("***")


def sanitized(name: Column) -> Column:
    """Letters, digits, '_' and '-' only."""
    return F.regexp_replace(name, r"(?U)[^\w-]", "")
