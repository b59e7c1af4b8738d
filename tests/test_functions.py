import base64
import json

import pytest
from pyspark.sql import functions as F

from siltflow.functions import naming, text, uris


def b64(x) -> str:
    return base64.b64encode(x.encode()).decode()


def one(spark, expr, **values):
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'binary' if isinstance(v, bytes) else 'string'}" for k, v in values.items()))
    return rows.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "name, body, want",
    [
        ("a.OVPN", "", "ovpn"), ("a.npv4", "", "npv4"), ("a.Conf", "x", "conf_lines"), ("a.ehi", "", "ehi"), ("a.hc", "", "hc"), ("a.hat", "", "hat"), ("a.sip", "", "sip"), ("a.nm", "", "nm"),
        ("a.dark", "", "dark"), ("a.npvtsub", "", "npvtsub"), ("a.txt", "vless://x@h:1", "npvt"), ("a.txt", "go to wss://x", "npvt"), ("a", "Hello World", "opaque_bundle"), ("a", "\x00\x01", "opaque_bundle"),
        ("a", b64("trojan://pw@h.example.com:443"), "npvt"), ("a", b64("nothing of that kind here"), "opaque_bundle"), ("", "", "opaque_bundle"),
    ],
)
def test_decide_format(spark, name, body, want):
    assert one(spark, naming.decide_format(F.col("n"), F.col("b")), n=name, b=body) == want


def test_split_lines(spark):
    s = "a\r\nb\nc\rd e\x85f\n"
    assert one(spark, text.split_lines(F.col("s")), s=s) == s.splitlines()


@pytest.mark.parametrize("s", ["YWI=YWJj", "aGVsbG8", "a-_b", "!!", "", "YQ", "YWJj\nZGVm"])
def test_base64_lenient(spark, s):
    assert one(spark, text.from_base64(F.col("s")), s=s) == text.lenient_base64(s)


def test_utf8_ignore_and_normalize(spark):
    assert one(spark, text.utf8_ignore(F.col("s")), s=b"a\xffb\xc3\xa9") == "abé"
    assert one(spark, text.normalize(F.col("s")), s=" ﬁ É 　") == "fi É"


VM = {"v": "2", "ps": "name", "add": "h.example.com", "port": "443", "id": "x", "aid": 0, "net": "ws"}


def test_strip_remark(spark):
    strip = lambda u: one(spark, uris.strip_remark(F.col("u")), u=u)
    assert strip("vless://a@h:1?x=1#tag") == "vless://a@h:1?x=1"
    assert strip("trojan://a@h:1#one#two") == "trojan://a@h:1#one"
    assert strip("vless://a@h:1") == "vless://a@h:1" and strip("#x") == "#x"
    a, b = (strip("vmess://" + b64(json.dumps(VM | {"ps": ps}))) for ps in ("one", "zwei é"))
    assert a == b == "vmess://" + b64(json.dumps({k: v for k, v in VM.items() if k != "ps"}, sort_keys=True, separators=(",", ":")))
    for broken in ("vmess://%%%", "vmess://" + b64("[1]"), "vmess://" + b64("3")):
        assert strip(broken) == broken


def test_with_remark(spark):
    name = lambda u: one(spark, uris.with_remark(F.col("u"), F.lit("vless-1")), u=u)
    assert name("vless://a@h:1#old") == "vless://a@h:1#vless-1"
    assert name("vmess://%%%") == "vmess://%%%"
    got = json.loads(base64.b64decode(name("vmess://" + b64(json.dumps(VM)))[8:]))
    assert got == VM | {"ps": "vless-1"} and list(got) == list(VM)


def test_line_uris(spark):
    found = lambda s: one(spark, uris.line_uris(F.col("s")), s=s)
    assert found("vless://a@h:1 and prose") == ["vless://a@h:1 and prose"]
    assert found('see VLESS://a@h:1 <ss://b@h:2> "tuic://c@h:3"') == ["VLESS://a@h:1", "ss://b@h:2", "tuic://c@h:3"]
    assert found("wss://x") == ["ss://x"] and found("nothing") == []


def entry(spark, uri):
    e = one(spark, uris.decode(F.col("u")), u=uri)
    return e and {k: v for k, v in e.asDict().items() if v is not None}


def test_decode_standard(spark):
    uri = "vless://us%20er:p%40ss@H.Example.COM:8443/p?type=ws&path=%2Fx+y&a=1&a=2&blank=#my%20tag"
    want = {"protocol": "vless", "user": "us er", "password": "p@ss", "address": "h.example.com", "port": 8443, "tag": "my tag", "params": {"type": ["ws"], "path": ["/x y"], "a": ["1", "2"]}, "raw": uri}
    assert entry(spark, uri) == want
    assert entry(spark, "hy2://k@[2001:db8::1]:443") == {"protocol": "hysteria2", "user": "k", "address": "2001:db8::1", "port": 443, "raw": "hy2://k@[2001:db8::1]:443"}
    assert entry(spark, "wg://k@h:notaport#t") == {"protocol": "wireguard", "raw": "wg://k@h:notaport#t"}
    assert entry(spark, "VLESS://k@h:1") is None and entry(spark, "http://h") is None


def test_decode_encoded(spark):
    u = f"ss://{b64('aes-256-gcm:pw')}@h.example.com:8388?plugin=x#a%20b"
    assert entry(spark, u) == {"protocol": "shadowsocks", "method": "aes-256-gcm", "password": "pw", "address": "h.example.com", "port": 8388, "tag": "a b", "raw": u}
    u = f"ss://{b64('rc4:p:w@h.example.com:1')}"
    assert entry(spark, u) == {"protocol": "shadowsocks", "method": "rc4", "password": "p:w", "address": "h.example.com", "port": 1, "tag": "", "raw": u}
    assert entry(spark, "ss://plain:pw@h:1")["method"] == "plain"
    assert entry(spark, f"ss://{b64('m:p')}@h:1/?plugin=x")["error"] == "decode_failed"
    u = "ssr://" + b64(f"h.example.com:443:origin:rc4:plain:{b64('pw')}/?remarks={b64('me')}")
    assert entry(spark, u) == {"protocol": "shadowsocksr", "address": "h.example.com", "port": 443, "ssr_protocol": "origin", "method": "rc4", "obfs": "plain", "password": "pw", "extra": {"remarks": "me"}, "raw": u}
    assert entry(spark, "vmess://!")["error"] == "decode_failed"
    u = "vmess://" + b64(json.dumps(VM))
    assert json.loads(entry(spark, u)["decoded"]) == VM


@pytest.mark.parametrize("n, want", [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1048575, "1024.0 KB"), (1048576, "1.0 MB"), (5 << 30, "5120.0 MB")])
def test_human_size(spark, n, want):
    assert one(spark, naming.human_size(F.col("n").cast("bigint")), n=str(n)) == want


@pytest.mark.parametrize("name, fmt, want", [("x.npvt.b64sub", "b64sub", True), ("x_npvt_b64sub.txt", "npvt.b64sub", True), ("x.npvt.decoded.json", "decoded.json", True), ("x_npvt_decoded.json", "npvt", False), ("r.ovpn", "ovpn", True), ("r_ovpn.zip", "ovpn", True), ("r.npvt", "npvt", True)])
def test_matches_format(spark, name, fmt, want):
    assert one(spark, naming.matches_format(F.col("n"), fmt), n=name) is want
