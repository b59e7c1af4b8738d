import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from siltflow import schemas
from siltflow.operators import keyed, messages
from siltflow.plans import config, formats, publish, route
from siltflow.queries import catalog
from siltflow.sources import files, sinks
from siltflow.sources import messages as feeds
from siltflow.streaming import ingest


def test_latest_keeps_one_row_after_fan_out(spark):
    r = spark.createDataFrame([(1, "b", "npvt", "k", True), (2, "b", "npvt", "k", True), (3, "c", "conf", "k", True), (4, "d", "npvt", "z", False)], "id long, source_file_hash string, record_type string, unique_hash string, is_active boolean")
    f = spark.createDataFrame([(1, "s1", "b"), (2, "s2", "b"), (3, "s1", "c"), (4, "s1", "d")], "id long, source_id string, raw_hash string")
    got = lambda *a: sorted((x["id"], x["file_id"]) for x in route.for_build(r, f, *a).collect())
    both = F.col("record_type").isin("npvt", "conf")
    assert got(both, F.lit(True)) == [(2, 2), (3, 3)]
    assert got(both, F.col("source_id") == "s1", F.lit(1)) == [(3, 3)]
    assert got(F.lit(False), F.lit(True)) == []


def test_insert_ignore_upsert_status(spark):
    a = spark.createDataFrame([("s", "1", 1)], "source_id string, external_id string, id long")
    b = spark.createDataFrame([("s", "1", 2), ("s", "2", 4), ("s", "2", 3)], a.schema)
    assert sorted(map(tuple, keyed.insert_ignore(a, b, ["source_id", "external_id"], ["id"]).collect())) == [("s", "1", 1), ("s", "2", 3)]
    s = spark.createDataFrame([("a", "bot", 1, 10)], "source_id string, source_type string, state long, updated_at long")
    n = spark.createDataFrame([("a", "user", 2, 20), ("a", "user", 3, 30), ("b", "user", 4, 40)], s.schema)
    assert sorted(map(tuple, keyed.upsert(s, n, ["source_id"], ["updated_at"], ["source_type"]).collect())) == [("a", "bot", 3, 30), ("b", "user", 4, 40)]
    assert keyed.watermark(s.limit(0), "state").first()[0] == 0


def test_stale_and_changed(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    routes = spark.createDataFrame([("all",)], "route string")
    assert [r[0] for r in keyed.stale(names("all.npvt", "all.hc", "README"), names("all.hc"), routes).collect()] == ["all.npvt"]
    ledger = spark.createDataFrame([(1, "r:a", "h1", 5), (2, "r:a", "h2", 5)], "id long, unique_id string, artifact_hash string, published_at long")
    results = spark.createDataFrame([("r:a", "h2"), ("r:b", "h1")], "unique_id string, artifact_hash string")
    assert [r["unique_id"] for r in keyed.changed(results, ledger).collect()] == ["r:b"]


def test_filters(spark):
    rows = spark.createDataFrame([("a.apk", 1), ("b.bin", messages.MOST_BYTES), ("c.bin", messages.MOST_BYTES + 1), ("D.APK", 1)], "name string, size long")
    t, f = F.lit(True), F.lit(False)
    got = rows.select(messages.skip_reason(t, t, t, f, t, F.col("name"), F.col("size"))).collect()
    assert [r[0] for r in got] == ["apk", None, "size", "apk"]


def message(**kw):
    return {"source_id": "s", "ts": 0.0, "chat_id": "c"} | kw


def test_stream_run_restarts(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    one = [message(id=1, text="vless://a@h:1#x"), message(id=2, caption="# no\nline", file_name="a.conf"), message(id=1, text="again")]
    (feed / "1.json").write_text("\n".join(map(json.dumps, one)))
    seen = []
    go = lambda: ingest.run(spark, feeds.stream(spark, str(feed)), str(tmp_path / "store"), str(tmp_path / "state"), lambda store, new, i: seen.append(sorted(r["external_id"] for r in new.collect())))
    go()
    go()
    (feed / "2.json").write_text(json.dumps(message(id=2, text="old")) + "\n" + json.dumps(message(id=7, text="new")))
    go()
    assert seen == [["1_text", "2_text"], ["7_text"]]
    table = files.Store(spark, str(tmp_path / "store")).read("seen_files", schemas.SEEN_FILES)
    ids = [r["id"] for r in table.orderBy("id").collect()]
    assert ids == [1, 2, (1 << 33) + 1] and table.where("status = 'pending'").count() == 3


def test_offset_source(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(json.dumps(message(id=i, text=f"t{i}")) for i in (3, 1, 2)))
    c = feeds.FolderConnector(str(tmp_path))
    assert [m["id"] for m in c.list_new({"offset": 1})] == [2, 3] and c.get_state() == {"offset": 3}
    q = feeds.stream_by_offset(spark, str(tmp_path)).writeStream.format("memory").queryName("offsets").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["id"] for r in spark.sql("SELECT id FROM offsets").collect()) == [1, 2, 3]


def test_retries():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 4:
            raise ConnectionError
        return "ok"

    assert feeds.with_retries(flaky, sleep=waits.append) == "ok" and waits == [1, 2, 4]
    with pytest.raises(TimeoutError):
        feeds.with_retries(lambda: (_ for _ in ()).throw(TimeoutError()), tries=2, sleep=waits.append)
    assert [feeds.stepped_wait(n) for n in range(10)] == [2, 2, 4, 4, 8, 8, 16, 16, 32, 32]


def test_transform_build_publish(spark):
    blobs = spark.createDataFrame([("h1", b"vless://a@h:1#x\nvless://a@h:1#y\ntrojan://b@h:2\nnoise"), ("h2", b"l1\n# c\nl2\nl1"), ("h3", b"\x00\x01")], "raw_hash string, content binary")
    pending = spark.createDataFrame([("h1", "s1", "a.txt"), ("h2", "s1", "b.conf"), ("h3", "s1", "c.ovpn"), ("h3", "s2", "c.ovpn"), ("h9", "s1", "d")], "raw_hash string, source_id string, filename string")
    sources = spark.createDataFrame([("s1", ["all"]), ("s2", ["npvt"])], "source_id string, include_formats array<string>")
    records, status = route.transform(pending, blobs, sources)
    got = sorted((r["raw_hash"], r["status"], r["error_msg"]) for r in status.collect())
    assert got == [("h1", "processed", None), ("h2", "processed", None), ("h3", "ignored", "Format ovpn not allowed"), ("h3", "processed", None), ("h9", "failed", "Raw data missing")]
    rows = records.withColumnRenamed("record_type", "format").select(F.lit("r").alias("route"), "format", F.lit(1).alias("id"), "pos", "data")
    built = route.build(rows, blobs)
    data = {r["format"]: bytes(r["data"]) for r in built.collect()}
    assert data["npvt"] == b"vless://a@h:1#vless-1\ntrojan://b@h:2#trojan-1" and data["conf_lines"] == b"l1\nl2"
    assert zipfile.ZipFile(io.BytesIO(data["ovpn"])).namelist() == ["c.ovpn"]
    more = {r["format"]: bytes(r["data"]) for r in route.derived(built).collect()}
    doc = json.loads(more["npvt.decoded.json"])
    assert doc["total"] == 2 and doc["protocols"] == {"vless": 1, "trojan": 1} and doc["entries"][1]["tag"] == "trojan-1"
    ledger = spark.createDataFrame([], "id long, unique_id string, artifact_hash string, published_at double")
    dest = spark.createDataFrame([("r", "c1", "tok:1", "{filename} {count}"), ("r", "c2", "", "x")], "route string, chat_id string, token string, caption_template string")
    plan = publish.delivery(publish.publishable(built, ledger), dest, F.current_timestamp())
    sent = []
    marked = publish.publish(plan, lambda r: sent.append(r["caption"]) or True, 1, 0.0)
    assert len(marked) == 3 and len(sent) == 3 and any(s.endswith(".conf 2") for s in sent)
    assert publish.publishable(built, spark.createDataFrame([m for m in marked], ledger.schema)).count() == 0
    with pytest.raises(RuntimeError):
        publish.publish(plan, lambda r: False, 1, 0.0)


def test_bundle_names_and_bytes(spark):
    rows = [(1, "a.bin"), (2, "a.bin"), (3, "1_a.bin"), (4, "b"), (5, "b"), (6, "b"), (7, "a.bin"), (8, "1_1_a.bin"), (9, "c")]
    named = keyed.collision_names(spark.createDataFrame(rows, "pos long, name string"), [], "name", ["pos"])
    used, want = [], []
    for _, name in rows:  # one after another
        k = 0
        while (f"{k}_{name}" if k else name) in used:
            k += 1
        used.append(f"{k}_{name}" if k else name)
    assert [r["entry"] for r in named.orderBy("pos").collect()] == used and used[:3] == ["a.bin", "1_a.bin", "1_1_a.bin"]
    rows = [("a.bin", b"1"), ("1_a.bin", b"2")]
    assert zipfile.ZipFile(io.BytesIO(sinks.bundle(rows))).namelist() == ["a.bin", "1_a.bin"]
    assert sinks.bundle(rows) == sinks.bundle(rows) and len(sinks.bundle([])) == 22


def test_numbering_in_ranges(spark):
    rows = [(g, v, i) for i, (g, v) in enumerate([("a", 5), (None, 1), ("a", 5), ("a", 100), (None, 2), ("b", 7), ("a", -3)])]
    got = keyed.numbered(spark.createDataFrame(rows, "g string, v long, i long"), ["g"], ["v", "i"], buckets=3).collect()
    want = {i: 1 + sum(h == g and (w, j) < (v, i) for h, w, j in rows) for g, v, i in rows}
    assert {r["i"]: r["n"] for r in got} == want


def test_transactions(spark, tmp_path):
    store = files.Store(spark, str(tmp_path / "s"))
    row = lambda i: spark.createDataFrame([(f"h{i}", b"x")], schemas.BLOBS)
    read = lambda: sorted(r[0] for r in store.read("blobs", schemas.BLOBS).collect())
    store.append("blobs", row(1))
    with pytest.raises(ZeroDivisionError):
        with store.transaction("t"):
            store.append("blobs", row(2))
            store.append("other", row(2))
            assert read() == ["h1", "h2"]
            1 / 0
    assert read() == ["h1"] and store.tagged("t") is None
    with store.transaction("t"):
        store.append("blobs", row(3))
        store.append("blobs", row(4))
    assert read() == ["h1", "h3", "h4"] and store.tagged("t") == 1 and store.folders("other") == []
    store.compact("blobs", schemas.BLOBS, most=2)
    assert read() == ["h1", "h3", "h4"] and len(store.folders("blobs")) == 1


def test_pages_resume():
    asked, waits = [], []

    def fetch(offset, size):
        asked.append(offset)
        if len(asked) in (2, 3) or 5 <= len(asked) < 12:
            raise ConnectionError
        return [{"id": i} for i in range(offset + 1, min(offset + size, 5) + 1)]

    assert [r["id"] for r in feeds.pages(fetch, 0, 2, waits.append)] == [1, 2, 3, 4, 5]
    assert asked == [0, 2, 2, 2] + [4] * 8 + [5] and waits == [1, 2, 1, 2, 4, 8, 16, 32, 2]


def test_judged_items(spark):
    """Each reason, and where the two kinds of connectors differ."""
    now, h = 1e6, 3600
    rows = [
        message(source_id="f", id=1, ts=now - 3 * h, text="late text"), message(source_id="f", id=2, ts=now - 3 * h, text="with file", data="x", file_name="n.conf"),
        message(source_id="u", id=3, ts=now - 3 * h, text="with file", data="x"), message(source_id="f", id=4, ts=now, caption="caption", gif=True), message(source_id="u", id=5, ts=now, caption="none", gif=True, text="t"),
        message(source_id="f", id=6, ts=now, file_name="A.APK", data="x"), message(source_id="u", id=7, ts=now, file_ext=".apk", data="x"), message(source_id="f", id=8, ts=now, file_name="big", file_size=messages.MOST_BYTES + 1),
        message(source_id="f", id=9, ts=now, file_name="fits", file_size=messages.MOST_BYTES, data="x"), message(source_id="c", id=10, ts=now, text="other chat", chat_id="d"), message(source_id="nobody", id=11, ts=now, text="x"),
    ]
    m = spark.createDataFrame([tuple(r.get(f.name) if f.name != "data" or r.get("data") is None else r["data"].encode() for f in schemas.MESSAGES.fields) for r in rows], schemas.MESSAGES)
    sources = spark.createDataFrame([("b", messages.BOT, None), ("f", messages.BOT, None), ("u", messages.USER, None), ("c", messages.BOT, "c")], "source_id string, source_type string, chat_id string")
    got = {(r["id"], r["is_text"]): (r["reason"], r["external_id"], r["filename"]) for r in messages.judged_items(m, sources, spark.createDataFrame([("b", 9)], "source_id string, offset long"), F.lit(now)).collect()}
    assert {k: v[0] for k, v in got.items()} == {
        (5, True): "media", (1, True): "old", (2, True): None, (2, False): None, (3, True): "old", (3, False): None, (4, True): None, (6, False): "apk", (7, False): "apk", (8, False): "size", (9, False): None, (10, True): "chat",
    } | {(5, True): "media"}
    assert got[2, True][1:] == ("2_text", "msg_2.txt") and got[2, False][1:] == ("2", "n.conf") and got[3, False][1:] == ("3_media", "media_3") and got[3, True][1] == "3"
    b = messages.judged_items(m.where("source_id = 'c'"), sources, spark.createDataFrame([("c", 10)], "source_id string, offset long"), F.lit(now)).collect()
    assert [r["reason"] for r in b] == ["offset"]


def test_blobs_listing_zip(spark, tmp_path):
    items = spark.createDataFrame([(b"x",), (b"x",), (b"y",)], "data binary")
    assert sinks.save_blobs(items, spark.createDataFrame([], schemas.BLOBS)).count() == 2
    sinks.write_atomic(str(tmp_path / "d" / "a.zip"), sinks.bundle([("q.ovpn", b"abc"), ("r.ovpn", b"d")]))
    sinks.write_atomic(str(tmp_path / "d" / "b.txt"), b"no zip")
    found = {r["name"]: r for r in files.zip_entries(files.listing(spark, str(tmp_path))).collect()}
    assert (found["a.zip"]["entries"], found["a.zip"]["bytes"], found["a.zip"]["extensions"]) == (2, 4, {".ovpn": 2}) and found["b.txt"]["entries"] is None
    assert sinks.export(spark.createDataFrame([("o", b"1")], "name string, data binary"), str(tmp_path / "out")) == 1
    docs = spark.createDataFrame([("d", '{"entries":[{"protocol":"vless"},{"protocol":"vless"},{"protocol":"ss"}]}')], "name string, text string")
    assert sorted(map(tuple, files.document_protocols(docs).collect())) == [("d", "ss", 1), ("d", "vless", 2)]


RAW = {"sources": [{"id": "a", "type": "telegram", "telegram": {"token": "${T}"}}], "publishing": {"routes": [{"name": "r", "from_sources": ["a"], "formats": ["npvt"]}]}}


def test_config(spark):
    c = config.parse(RAW, {"T": "1:x"})
    assert c.sources[0].settings == {"token": "1:x"} and config.tables(spark, c)["route_sources"].count() == 1
    for bad in (RAW | {"sources": RAW["sources"] * 2}, {"sources": []}, RAW | {"sources": []}):
        with pytest.raises(config.ConfigError):
            config.parse(bad, {"T": "1:x"})
    with pytest.raises(config.ConfigError):
        config.parse(RAW, {})


def test_registry():
    assert formats.get("nope") is None and len(formats.names()) == 12


def test_migrated(spark):
    old = spark.createDataFrame([(1, "s")], "id long, source_id string")
    assert schemas.migrated(old, schemas.SEEN_FILES).first()["metadata_json"] is None


def test_run_once_and_again(spark, tmp_path):
    from siltflow.__main__ import main
    from siltflow.plans import run, users

    feed, data = tmp_path / "feed", tmp_path / "data"
    feed.mkdir()
    route = {"name": "r", "from_sources": ["s", "twin"], "formats": ["npvt", "conf_lines", "ovpn"], "destinations": [{"chat_id": "c", "token": "t:1"}]}
    settings = config.parse({"sources": [{"id": i, "type": "telegram_user", "telegram_user": {"api_id": 1, "peer": "p"}} for i in ("s", "twin")], "publishing": {"routes": [route]}})
    sent, given, now = [], [], 1.7e9
    store = files.Store(spark, str(data / "state"))
    seen = [("u", "c", "n", 1.0), ("w", "c", "m", 1.0)]
    store.replace("users", users.update(users.register(store.read("users", schemas.USERS), spark.createDataFrame(seen, "user_id string, chat_id string, username string, registered_at double")), "w", muted=True))

    def go(at=now):
        run.once(spark, settings, str(feed), str(data), lambda r: sent.append(r["unique_id"]) or True, run.Options(now=at), lambda r: given.append((r["user_id"], r["name"])) or True)

    names = lambda folder: sorted(p.name for p in (data / folder).iterdir())
    many = [f"tuic://u{i}@h:{i}" for i in range(1, 40)]
    rows = [message(id=1, ts=now, text="\n".join([*many, "vless://a@h:1#x", "vless://a@h:1#y"])), message(id=2, ts=now, file_name="a.conf", data="bDE="), message(id=3, ts=now, file_name="b.ovpn", data="AAE=")]
    rows += [message(id=8, ts=0.0, file_name="virus.apk", data="AAE="), message(id=9, ts=0.0, file_name="c.ovpn", data="BBBB"), message(id=10, ts=now, photo=True, text="vless://no@h:1"), message(source_id="twin", id=11, ts=now, text="vless://twin@h:1")]
    (feed / "1.json").write_text("\n".join(map(json.dumps, rows)))
    go()
    assert names("output") == ["r.conf_lines", "r.npvt", "r.ovpn", "r_npvt_b64sub.txt", "r_npvt_decoded.json"] and names("history") == ["proxies.json", "proxies.txt", "proxies_b64sub.txt"]
    want = [f"{u}#tuic-{i}" for i, u in enumerate(many, 1)] + ["vless://a@h:1#vless-1"]
    assert (data / "output" / "r.npvt").read_text().split("\n") == want and len(sent) == 5 and zipfile.ZipFile(data / "output" / "r.ovpn").namelist() == ["b.ovpn"]
    assert json.loads((data / "catalog.json").read_text())["total_files"] == 5 and sorted(given) == [("u", "r.npvt"), ("u", "r_npvt_b64sub.txt")]
    skips = {(r["source_id"], r["reason"]): r["n"] for r in store.read("skips", schemas.SKIPS).collect()}
    assert skips == {("s", "kept"): 3, ("s", "old"): 2, ("s", "media"): 1}  # the twin reads a channel that has its source
    state = store.read("source_state", schemas.SOURCE_STATE).collect()
    assert [(r["source_id"], r["state"]["offset"], r["state"]["stats"]["total_files"], r["state"]["stats"]["last_run"]["text_items"]) for r in state] == [("s", 10, 3, 1)]
    assert {r["user_id"]: r["last_delivered_at"] for r in store.read("users", schemas.USERS).collect()} == {"u": now, "w": None}
    go(now + 5)
    assert len(names("archive")) == 5 and len(sent) == 5  # nothing new, nothing done
    (feed / "2.json").write_text(json.dumps(message(id=14, ts=now, text="trojan://b@h:2")) + "\n" + json.dumps(message(id=15, ts=now, text="vless://a@h:1#z")) + "\n" + json.dumps(message(id=4, ts=now, text="vless://late@h:1")))
    go(now + 5 * 86400)
    assert sorted((data / "output" / "r.npvt").read_text().split("\n")) == ["trojan://b@h:2#trojan-1", "vless://a@h:1#vless-1"] and len(sent) == 8
    assert names("output") == ["r.npvt", "r_npvt_b64sub.txt", "r_npvt_decoded.json"]  # the others of the route are stale
    assert run.pending(store).count() == 0 and store.read("records", schemas.RECORDS).count() == 44
    assert store.read("manifest", schemas.MANIFEST).count() == 41 and "41 unique" in (data / "history" / "proxies.txt").read_text()
    # texts are told and no record needs them: their records hold the lines; a bundle's record has its blob's hash
    assert main(["clean", "--data", str(data)]) == 0 and not (data / "output").exists()
    assert main(["reset", "--yes", "--data", str(data)]) == 0 and not (data / "state").exists()


def test_history_and_catalog(spark):
    from siltflow.plans import history

    manifest = spark.createDataFrame([("vless://a@h:1", 5.0), ("ss://b@h:2", 9.0)], schemas.MANIFEST)
    lines = spark.createDataFrame([("vless://a@h:1#again",), ("vless://c@h:3#x",), ("no uri",)], "line string")
    after = history.remember(manifest, lines, F.lit(9.0))
    assert sorted(map(tuple, after.collect())) == [("ss://b@h:2", 9.0), ("vless://a@h:1", 5.0), ("vless://c@h:3", 9.0)]
    got = {r["name"]: bytes(r["data"]).decode() for r in history.history_files(after, F.lit("2024-01-02 03:04:05").cast("timestamp")).collect()}
    assert got["proxies.txt"].split("\n\n")[1] == "ss://b@h:2#ss-1\nvless://c@h:3#vless-1\nvless://a@h:1#vless-2\n" and "3 unique" in got["proxies.txt"] and "2024-01-02 03:04:05 UTC" in got["proxies.txt"]
    doc = json.loads(got["proxies.json"])
    assert doc["_count"] == 3 and doc["proxies"][2] == {"uri": "vless://a@h:1#vless-2", "first_seen": 5.0}
    assert history.history_files(after.limit(0), F.current_timestamp()).count() == 0
    listing = spark.createDataFrame([("a.txt", 0, 2000, b"x"), ("b", 0, 10, b"y")], "name string, modified long, size long, content binary").withColumn("modified", F.timestamp_seconds("modified"))
    doc = json.loads(history.catalog_json(history.catalog(listing, "latest"), F.current_timestamp()).first()["json"])
    assert (doc["total_files"], doc["total_size"], doc["total_size_str"]) == (2, 2010, "2.0 KB") and [f["type"] for f in doc["files"]] == ["TXT", "UNKNOWN"] and doc["files"][0]["hash"] == "9dd4e461"


def test_users(spark):
    from siltflow.operators.stats import user_stats
    from siltflow.plans import users

    none = spark.createDataFrame([], schemas.USERS)
    one = users.register(none, spark.createDataFrame([("u", "c", "n", 1.0), ("w", "d", "m", 1.0)], "user_id string, chat_id string, username string, registered_at double"))
    two = users.register(users.update(one, "u", muted=True, default_format="ovpn"), spark.createDataFrame([("u", "c2", "n2", 2.0)], "user_id string, chat_id string, username string, registered_at double"))
    row = two.where("user_id = 'u'").first()
    assert (row["chat_id"], row["username"], row["registered_at"], row["muted"], row["default_format"]) == ("c2", "n2", 1.0, True, "ovpn")
    assert tuple(user_stats(two).first()) == (2, 1, 1)
    empty = spark.createDataFrame([], "name string, size long, modified timestamp")
    old = spark.createDataFrame([("r_1.ovpn", 5, 0)], "name string, size long, m long").select("name", "size", F.timestamp_seconds("m").alias("modified"))
    assert users.files_for(empty, old, "ovpn", F.lit("1970-01-03").cast("timestamp")).count() == 1 and users.files_for(empty, old, "ovpn", F.lit("1970-01-09").cast("timestamp")).count() == 0


def test_artifacts_are_written_once(spark, tmp_path, monkeypatch):
    """What is exported, published and delivered is read from what was built, and not built again for each of these."""
    from siltflow.plans import run

    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "1.json").write_text("\n".join(json.dumps(message(id=i, ts=1.7e9, text=f"vless://a{i}@h:1")) for i in (1, 2)))
    settings = config.parse({"sources": [{"id": "s", "type": "telegram_user", "telegram_user": {"api_id": 1, "peer": "p"}}], "publishing": {"routes": [{"name": r, "from_sources": ["s"], "formats": ["npvt"]} for r in ("a", "b")]}})
    plans, export_run = [], run.export_run
    monkeypatch.setattr(run, "export_run", lambda spark, built, *more: plans.append(built._jdf.queryExecution().analyzed().toString()) or export_run(spark, built, *more))
    run.once(spark, settings, str(tmp_path / "feed"), str(tmp_path / "data"), options=run.Options(now=1.7e9))
    assert len(plans) == 1 and not any(x in plans[0] for x in ("Aggregate", "Join", "Union"))
    assert (tmp_path / "data" / "output" / "b.npvt").read_text() == "vless://a1@h:1#vless-1\nvless://a2@h:1#vless-2"
    assert not list((tmp_path / "data" / "state" / "_scratch").iterdir())


def test_transactions_leave_scratch_alone(spark, tmp_path):
    store = files.Store(spark, str(tmp_path))
    kept = tmp_path / "_scratch" / "a17553388"  # reads as a number like those of transactions
    kept.mkdir(parents=True)
    with store.transaction():
        assert kept.exists()


def test_joined_digest_is_that_of_joined_lines(spark):
    rows = [(k, i, c * (i + 1)) for k in ("a", "b", None) for i, c in enumerate("xyé\n")]
    df = spark.createDataFrame(rows, "k string, i int, v string").repartition(3)
    got = keyed.joined_digest(df, ["k"], "v", ["i"])
    want = {k: (hashlib.sha256("\n".join(v for x, _, v in rows if x == k).encode()).hexdigest(), 4) for k in ("a", "b", None)}
    assert {r["k"]: (r["artifact_hash"], r["n"]) for r in got.collect()} == want
    plan = catalog.QUERIES["route_conf_artifact"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_small_tables_have_a_size(spark, tmp_path):
    """What the configuration gives is joined without a shuffle, and with a table that isn't there yet there is no join."""
    optimized = lambda df: df._jdf.queryExecution().optimizedPlan()
    small = files.table(spark, [("s", ["a", "b"], None)], "source_id string, formats array<string>, chat string")
    assert small.collect() == [("s", ["a", "b"], None)] and files.table(spark, [], "a long").schema.simpleString() == "struct<a:bigint>"
    sources = config.tables(spark, config.parse({"sources": [{"id": "s", "type": "telegram_user", "telegram_user": {"api_id": 1}}], "publishing": {"routes": []}}))["sources"]
    assert all(x.collect() and "LocalRelation" in optimized(x).toString() for x in (small, sources))
    new = keyed.unseen(spark.range(3).select(F.col("id").alias("raw_hash")), files.Store(spark, str(tmp_path)).read("blobs", schemas.BLOBS), ["raw_hash"])
    assert new.count() == 3 and "Join" not in optimized(new).toString()


def test_steps_together(spark, tmp_path):
    import threading

    store, both, half = files.Store(spark, str(tmp_path / "s")), threading.Barrier(2, timeout=60), threading.Event()
    row = lambda i: spark.createDataFrame([(f"h{i}", b"x")], schemas.BLOBS)
    rows = lambda s, name: sorted(r[0] for r in s.read(name, schemas.BLOBS).collect())
    store.together(lambda s: both.wait() >= 0 and s.append("a", row(1)), lambda s: both.wait() >= 0 and s.append("b", row(2)))
    assert sorted(store.commits()) == [0, 1]  # one transaction after the other
    with store.transaction() as n:
        store.together(lambda s: both.wait() >= 0 and s.append("a", row(3)), lambda s: both.wait() >= 0 and s.append("b", row(4)))
        assert rows(store, "a") == ["h1", "h3"] and sorted(store.commits()) == [0, 1]
    assert n == 2 and sorted(store.commits()) == [0, 1, 2]

    def fails(s):
        with s.transaction():
            s.append("a", row(5))
            half.set()
            both.wait()
            1 / 0

    def reads(s):
        assert half.wait(60) and rows(s, "a") == ["h1", "h3"]  # another step's open transaction isn't seen
        both.wait()
        s.append("b", row(6))

    with pytest.raises(ZeroDivisionError):
        store.together(fails, reads)
    assert rows(store, "a") == ["h1", "h3"] and rows(store, "b") == ["h2", "h4", "h6"]


def test_messages_are_judged_once(spark, tmp_path, monkeypatch):
    """Blobs, seen files, offsets and statistics are made of what was judged, and not each of the messages again."""
    from siltflow.plans import run

    plans, record_sources = [], run.record_sources
    monkeypatch.setattr(run, "record_sources", lambda store, judged, *more: plans.append(judged._jdf.queryExecution().analyzed().toString()) or record_sources(store, judged, *more))
    settings = config.parse({"sources": [{"id": "s", "type": "telegram_user", "telegram_user": {"api_id": 1, "peer": "p"}}], "publishing": {"routes": []}})
    store = files.Store(spark, str(tmp_path / "state"))
    rows = spark.createDataFrame([("s", i, 1.7e9, f"vless://a{i}@h:1") for i in (1, 2)], "source_id string, id long, ts double, text string")
    new = run.ingest_batch(store, schemas.migrated(rows, schemas.MESSAGES), "batch-0", config.tables(spark, settings)["sources"], 1.7e9, messages.Windows())
    assert new.count() == 2 and not any(x in plans[0] for x in ("Union", "Join")) and store.read("blobs", schemas.BLOBS).count() == 2
    assert [(r["state"]["offset"], r["state"]["stats"]["total_files"]) for r in store.read("source_state", schemas.SOURCE_STATE).collect()] == [(2, 2)]
    assert not list((tmp_path / "state" / "_scratch").iterdir())


def test_failed_send_loses_nothing_else(spark, tmp_path):
    """Publishing goes on beside the other steps: where it fails, the list of URIs and the outputs are there all the same."""
    from siltflow.plans import run

    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "1.json").write_text(json.dumps(message(id=1, ts=1.7e9, text="vless://a@h:1")))
    route = {"name": "r", "from_sources": ["s"], "formats": ["npvt"], "destinations": [{"chat_id": "c", "token": "t:1"}]}
    settings = config.parse({"sources": [{"id": "s", "type": "telegram_user", "telegram_user": {"api_id": 1, "peer": "p"}}], "publishing": {"routes": [route]}})
    with pytest.raises(RuntimeError, match="not published"):
        run.once(spark, settings, str(tmp_path / "feed"), str(tmp_path / "data"), lambda r: False, run.Options(now=1.7e9))
    store = files.Store(spark, str(tmp_path / "data" / "state"))
    assert store.read("manifest", schemas.MANIFEST).collect() == [("vless://a@h:1", 1.7e9)] and store.folders("published") == []
    assert (tmp_path / "data" / "output" / "r.npvt").read_text() == "vless://a@h:1#vless-1" and (tmp_path / "data" / "history" / "proxies.txt").exists()


def test_parse_reads_alike_formats_together(spark):
    from siltflow.functions import text

    odd = [b"a", "ﬁ Ａ\n".encode(), b"\xff\xfe x", "café  ".encode() + b"\xc3", b"", None]
    rows = spark.createDataFrame([(x,) for x in odd], "d binary").select(text.normal_text(F.col("d")).alias("a"), text.normalize(text.utf8_ignore(F.col("d"))).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and rows[1]["a"] == "fi A"
    blobs = [("h1", "x.txt", "npvt", b"vless://a@h:1#x\nvless://a@h:1#y"), ("h1", "x.npvtsub", "npvtsub", b"vless://a@h:1#x\nvless://a@h:1#y"), ("h2", "a.conf", "conf_lines", b"l\n# c\nl")]
    got = formats.parse(spark.createDataFrame(blobs, "raw_hash string, filename string, fmt string, content binary"))
    assert sorted((r["raw_hash"], r["record_type"], r["data"]["line"]) for r in got.collect()) == [("h1", "npvt", "vless://a@h:1"), ("h1", "npvtsub", "vless://a@h:1"), ("h2", "conf_lines", "l")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 2
