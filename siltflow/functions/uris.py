"""Proxy URIs: finding, stripping and numbering remarks, decoding."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import arrow_udf

from ..schemas import ENTRY
from .text import decoded_list, from_base64, lenient_base64

# The known schemes, and the names that two of them have in decoded entries.
SCHEMES = "vmess vless trojan ss ssr hysteria2 hy2 hysteria tuic wireguard wg socks socks5 socks4 anytls juicity warp dns dnstt".split()
ALIASES = {"hy2": "hysteria2", "wg": "wireguard", "ss": "shadowsocks", "ssr": "shadowsocksr"}

ANY_SCHEME = "(?:" + "|".join(SCHEMES) + ")://"
EMBEDDED = "(?i)" + ANY_SCHEME + r"[^\s<>\"']+"


def is_uri_line(line: Column) -> Column:
    """Starts with a known scheme; case matters."""
    return line.rlike("^" + ANY_SCHEME)


def embedded_uris(line: Column) -> Column:
    """All URIs in a line, wherever they begin and in any case."""
    return F.regexp_extract_all(line, F.lit(EMBEDDED), F.lit(0))


def line_uris(line: Column) -> Column:
    """A line that starts with a scheme is kept whole; of others, the URIs inside."""
    return F.when(is_uri_line(line), F.array(line)).otherwise(embedded_uris(line))


def scheme_of(uri: Column) -> Column:
    return F.when(F.contains(uri, F.lit("://")), F.lower(F.substring_index(uri, "://", 1))).otherwise("proxy")


def _vmess_object(uri: str) -> dict | None:
    raw = lenient_base64(uri[8:])
    try:
        found = json.loads(raw) if raw is not None else None
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def _vmess_uri(obj: dict, in_order: bool) -> str:
    return "vmess://" + base64.b64encode(json.dumps(obj, sort_keys=in_order, separators=(",", ":")).encode()).decode()


@arrow_udf(T.StringType())
def _vmess_bare(uris: pa.Array) -> pa.Array:
    """vmess URIs without their remark, keys in order; null where the payload isn't a JSON object."""
    objects = [_vmess_object(u) if u and u.startswith("vmess://") else None for u in uris.to_pylist()]
    return pa.array([None if o is None else _vmess_uri({k: v for k, v in o.items() if k != "ps"}, True) for o in objects], pa.string())


@arrow_udf(T.StringType())
def _vmess_named(uris: pa.Array, tags: pa.Array) -> pa.Array:
    pairs = zip(uris.to_pylist(), tags.to_pylist())
    objects = [(_vmess_object(u) if u and u.startswith("vmess://") else None, t) for u, t in pairs]
    return pa.array([None if o is None else _vmess_uri(o | {"ps": t}, False) for o, t in objects], pa.string())


def strip_fragment(uri: Column) -> Column:
    """Up to the last '#', unless that is the first character."""
    return F.regexp_replace(uri, r"(?s)(?<=.)#[^#]*$", "")


def strip_remark(uri: Column) -> Column:
    plain = strip_fragment(uri)
    return F.when(uri.startswith("vmess://"), F.coalesce(_vmess_bare(uri), plain)).otherwise(plain)


def with_remark(uri: Column, tag: Column) -> Column:
    """The URI with `tag` as its remark; a vmess URI that can't be decoded stays as it is."""
    plain = F.concat(strip_fragment(uri), F.lit("#"), tag)
    return F.when(uri.startswith("vmess://"), F.coalesce(_vmess_named(uri, tag), uri)).otherwise(plain)


def unquoted(text: Column) -> Column:
    """Percent-decoded; '+' stays, and so does what can't be decoded."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def standard_entry(uri: Column, protocol: Column) -> Column:
    """scheme://user:password@host:port?params#tag as an ENTRY; with a port that isn't one, the protocol alone."""
    some = lambda x: F.nullif(x, F.lit(""))
    place = F.regexp_extract(uri, r"^[A-Za-z0-9]+://([^/?#]*)", 1)
    user_info = F.regexp_extract(place, r"(?s)^(.*)@", 1)
    host_port = F.regexp_replace(place, r"(?s)^.*@", "")
    host = F.when(host_port.startswith("["), F.regexp_extract(host_port, r"^\[([^\]]*)\]", 1)).otherwise(F.substring_index(host_port, ":", 1))
    port = F.regexp_extract(host_port, r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1)
    number = F.when(port.rlike("^[0-9]{1,9}$"), port.cast("bigint"))
    bad = (port != "") & (number.isNull() | (number > 65535))
    password = F.regexp_extract(user_info, r"(?s)^[^:]*:(.*)$", 1)
    tag = F.regexp_extract(uri, r"(?s)^[^#]*#(.*)$", 1)
    query = F.regexp_extract(uri, r"^[^?#]*\?([^#]*)", 1)
    value = lambda p: F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)
    decode = lambda x: F.coalesce(F.try_url_decode(x), x)
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: value(p) != ""), lambda p: F.struct(decode(F.substring_index(p, "=", 1)).alias("k"), decode(value(p)).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    params = F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"]))))
    fields = {
        "protocol": protocol,
        "user": some(unquoted(F.substring_index(user_info, ":", 1))),
        "password": some(unquoted(password)),
        "address": some(F.lower(host)),
        "port": F.when(number > 0, number),
        "tag": some(unquoted(tag)),
        "params": F.when(F.size(keys) > 0, params),
    }
    only = {"protocol", "raw"}
    columns = []
    for f in ENTRY.fields:
        v = uri if f.name == "raw" else fields.get(f.name, F.lit(None))
        columns.append((v if f.name in only else F.when(~bad, v)).cast(f.dataType).alias(f.name))
    return F.struct(*columns)


def _entry(uri: Column, protocol: str, **fields: Column) -> Column:
    """An ENTRY of some fields; the others are null."""
    known = {"protocol": F.lit(protocol), "raw": uri} | fields
    return F.struct(*((known[f.name] if f.name in known else F.lit(None)).cast(f.dataType).alias(f.name) for f in ENTRY.fields))


def _port(text: Column) -> Column:
    return F.when(text.rlike(r"^[+-]?[0-9]{1,9}$"), text.cast("bigint"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed, and written in the plan, once. The body has no Python functions."""
    return F.transform(F.array(value), body)[0]


def shadowsocks_entry(uri: Column) -> Column:
    """ss://BASE64(method:password)@host:port?plugin#tag, or ss://BASE64(method:password@host:port)#tag."""
    body = F.regexp_extract(uri, "(?s)^ss://(.*?)(?:#[^#]*)?$", 1)
    coded = F.when(F.contains(body, F.lit("@")), F.regexp_extract(body, "(?s)^(.*)@", 1)).otherwise(F.substring_index(body, "?", 1))

    def parts(v: Column) -> Column:
        body, inside = v["body"], v["inside"]
        in_clear, owner = F.contains(body, F.lit("@")), F.regexp_extract(body, "(?s)^(.*)@", 1)
        # an owner that isn't base64 but has a colon is method:password itself
        plain = inside.isNull() | (~F.contains(inside, F.lit(":")) & F.contains(owner, F.lit(":")))
        secret = F.when(~in_clear, F.regexp_extract(inside, "(?s)^(.*)@", 1)).when(plain, unquoted(owner)).otherwise(inside)
        server = F.when(in_clear, F.regexp_extract(body, "(?s)^.*@([^@?]*)", 1)).otherwise(F.regexp_extract(inside, "(?s)^.*@(.*)$", 1))
        state = F.when(in_clear, "whole").when(inside.isNull(), "failed").when(F.contains(inside, F.lit("@")), "whole").otherwise("unknown")
        return F.struct(v["uri"].alias("uri"), inside.alias("inside"), secret.alias("secret"), server.alias("server"), state.alias("state"))

    def entry(v: Column) -> Column:
        server, secret, with_port = v["server"], v["secret"], F.contains(v["server"], F.lit(":"))
        number = F.when(with_port, _port(F.regexp_extract(server, "(?s):([^:]*)$", 1))).otherwise(F.lit(0))
        whole, failed = (v["state"] == "whole") & number.isNotNull(), (v["state"] == "failed") | ((v["state"] == "whole") & number.isNull())
        tag = F.when(F.contains(v["uri"], F.lit("#")), unquoted(F.regexp_extract(v["uri"], "(?s)#([^#]*)$", 1))).otherwise("")
        address = F.when(with_port, F.regexp_extract(server, "(?s)^(.*):", 1)).otherwise(server)
        fields = {"method": F.regexp_extract(secret, "(?s)^([^:]*)", 1), "password": F.regexp_extract(secret, "(?s)^[^:]*:(.*)$", 1), "address": address, "port": number, "tag": tag}
        return _entry(v["uri"], "shadowsocks", error=F.when(failed, "decode_failed"), decoded_text=F.when(v["state"] == "unknown", v["inside"]), **{k: F.when(whole, x) for k, x in fields.items()})

    return _let(F.struct(uri.alias("uri"), body.alias("body"), from_base64(coded).alias("inside")), lambda v: _let(parts(v), entry))


SSR = "(?s)^(.*):([^:]*):([^:]*):([^:]*):([^:]*):([^:]*)$"


def shadowsocksr_entry(uri: Column) -> Column:
    """ssr://BASE64(host:port:protocol:method:obfs:BASE64(password)/?key=BASE64(value)&...); a host may have colons."""
    inside = from_base64(F.regexp_extract(uri, "(?s)^ssr://(.*)$", 1))
    main = F.substring_index(inside, "/?", 1)
    pairs = F.filter(F.split(F.regexp_extract(inside, r"(?s)^.*?/\?(.*)$", 1), "&"), lambda p: F.contains(p, F.lit("=")))
    values = F.array_join(F.transform(pairs, lambda p: F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)), "\n")
    known = F.struct(uri.alias("uri"), inside.alias("inside"), main.alias("main"), from_base64(F.regexp_extract(main, SSR, 6)).alias("password"), pairs.alias("pairs"), F.split(decoded_list(values), "\n").alias("clear"))

    def entry(v: Column) -> Column:
        part = lambda i: F.regexp_extract(v["main"], SSR, i)
        number, formed = _port(F.trim(part(2))), v["main"].rlike(SSR)
        whole = formed & v["password"].isNotNull() & number.isNotNull()
        keys = F.transform(v["pairs"], lambda p: F.substring_index(p, "=", 1))
        later = lambda known, e: F.map_concat(F.map_filter(known, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"]))
        extra = F.when(F.size(v["pairs"]) > 0, F.aggregate(F.arrays_zip(keys.alias("k"), v["clear"].alias("v")), F.create_map().cast("map<string,string>"), later))
        fields = {"address": part(1), "port": number, "ssr_protocol": part(3), "method": part(4), "obfs": part(5), "password": v["password"], "extra": extra}
        failed = v["inside"].isNull() | (formed & ~whole)
        return _entry(v["uri"], "shadowsocksr", error=F.when(failed, "decode_failed"), decoded_text=F.when(~formed, v["inside"]), **{k: F.when(whole, x) for k, x in fields.items()})

    return _let(known, entry)


@arrow_udf(T.StringType())
def _vmess_json(uris: pa.Array) -> pa.Array:
    """The payload of vmess URIs as JSON, null where it isn't an object."""
    objects = [None if u is None else _vmess_object(u) for u in uris.to_pylist()]
    return pa.array([None if o is None else json.dumps(o, ensure_ascii=False) for o in objects], pa.string())


def vmess_entry(uri: Column) -> Column:
    text = _vmess_json(uri)
    return _entry(uri, "vmess", decoded=text, error=F.when(text.isNull(), "decode_failed"))


def decode(uri: Column) -> Column:
    """A proxy URI as an ENTRY; null for other lines. Python only decodes lenient base64."""
    scheme = F.regexp_extract(uri, "^(" + "|".join(SCHEMES) + ")://", 1)
    names = F.create_map(*(F.lit(x) for s in SCHEMES for x in (s, ALIASES.get(s, s))))
    out = F.when(~scheme.isin("", "vmess", "ss", "ssr"), standard_entry(uri, names[scheme]))
    for name, entry in (("vmess", vmess_entry), ("ss", shadowsocks_entry), ("ssr", shadowsocksr_entry)):
        out = out.when(scheme == name, entry(F.when(scheme == name, uri)))
    return out


def outbound(entry: Column) -> Column:
    """A decoded vmess entry as a client's outbound struct, with the usual defaults."""
    of = lambda k: F.get_json_object(entry["decoded"], f"$.{k}")
    user = F.struct(of("id").alias("id"), F.coalesce(of("aid").cast("int"), F.lit(0)).alias("alterId"), F.lit("auto").alias("security"), F.lit(0).alias("level"))
    server = F.struct(of("add").alias("address"), F.coalesce(of("port").cast("int"), F.lit(443)).alias("port"), F.array(user).alias("users"))
    stream = F.struct(F.coalesce(of("net"), F.lit("tcp")).alias("network"), F.coalesce(of("tls"), F.lit("none")).alias("security"))
    return F.struct(F.lit("vmess").alias("protocol"), F.struct(F.array(server).alias("vnext")).alias("settings"), stream.alias("streamSettings"), F.coalesce(of("ps"), F.lit("proxy")).alias("tag"))
