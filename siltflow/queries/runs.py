"""Queries over two whole runs of the engine: what filters, state tables, outputs and tidying up leave.

Events stand for messages of five sources; the first run reads the older half, the second the rest and some of the
first again. Both write below the folder that the session shares; the runs over one folder of tables are made once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import messages
from ..plans import config, run as runs, users
from ..schemas import BLOBS, MANIFEST, MESSAGES, PUBLISHED, RECORDS, SEEN_FILES, SKIPS, SOURCE_STATE, STATUS, USERS
from ..sources.files import Store, blob_lookup, dated, document_protocols, listing, recent, zip_entries
from .streams import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_done: dict[tuple[str, str], str] = {}

SETTINGS = {
    "sources": [
        {"id": "s0", "type": "telegram", "telegram": {"token": "${TOKEN}"}},
        {"id": "s1", "type": "telegram", "telegram": {"token": "${TOKEN}", "chat_id": "c0"}, "selector": {"include_formats": ["npvt"]}},
        {"id": "s2", "type": "telegram_user", "telegram_user": {"api_id": "1", "peer": "p2"}},
        {"id": "s3", "type": "telegram_user", "telegram_user": {"api_id": "1", "peer": "p3"}},
        {"id": "s4", "type": "telegram_user", "telegram_user": {"api_id": "1", "peer": "p2"}},
    ],
    "publishing": {
        "routes": [
            {"name": "all", "from_sources": ["s0", "s1", "s2"], "formats": ["npvt", "conf_lines", "ovpn"], "destinations": [{"chat_id": "d", "token": "t:1"}]},
            {"name": "few", "from_sources": ["s3"], "formats": ["npvt", "opaque_bundle"]},
        ]
    },
}
WINDOWS = messages.Windows(text_fresh=72, file_fresh=240)
FIRST, SECOND = 1_800_000_000.0, 1_800_400_000.0


def seconds() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp")) / 1e6


def feed(events: DataFrame) -> DataFrame:
    kind, user, k = F.col("event_type"), F.col("user_id"), F.col("event_id")
    text = lambda *x: F.concat(*(F.lit(a) if isinstance(a, str) else a.cast("string") for a in x))
    made = {
        "source_id": text("s", k % 5), "id": k + 1, "ts": seconds(), "chat_id": text("c", user % 3),
        "text": F.when(kind == "click", text("vless://u", k % 200, "@h.example.com:443#x", k)).when(kind == "view", "seen").when(kind == "purchase", F.col("props")),
        "caption": F.when(kind == "signup", text("trojan://s", user % 30, "@t.example.com:8443")), "file_name": F.when(kind == "error", text("e", user % 40, F.when(user % 10 == 0, ".Apk").otherwise(".conf"))).when(kind == "purchase", text("p", user % 5, ".ovpn")),
        "file_size": F.when((kind == "error") & (k % 9 == 0), 30_000_000), "data": F.encode(F.when(kind == "error", text("line ", k % 50, "\n# c\nline ", user)).when(kind == "purchase", F.col("props")), "UTF-8"), "photo": kind == "view",
    }
    return events.select(*((made[f.name] if f.name in made else F.lit(None)).cast(f.dataType).alias(f.name) for f in MESSAGES.fields))


def state(spark: SparkSession, sf_dir: str) -> tuple[Store, str]:
    """The store and the folder of the two runs."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _done:
        root = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
        data, events = f"{root}/data".removeprefix("file://").removeprefix("file:"), spark.read.parquet(f"{sf_dir}/events.parquet")
        settings = config.parse(SETTINGS, {"TOKEN": "1:x"})
        store = Store(spark, f"{data}/state")
        seen = spark.range(20).select(F.col("id").cast("string").alias("user_id"), F.lit("c").alias("chat_id"), F.lit("n").alias("username"), F.lit(1.0).alias("registered_at"))
        known = users.register(store.read("users", USERS), seen).withColumn("muted", F.col("user_id").cast("int") % 4 == 0)
        half: list[int] = []
        store.together(lambda s: half.append(events.agg(F.max("event_id")).first()[0] // 2), lambda s: s.replace("users", known))
        parts = [x.format(half[0]) for x in ("event_id < {0}", "event_id >= {0} * 4 div 5")]
        newest = events.agg(*(F.max(F.when(F.expr(x), seconds())) for x in parts)).first()

        def come(k: int, name: str) -> None:
            # messages are dated by the events, so their clock is moved to the run's
            rows = feed(events.where(parts[k])).withColumn("ts", F.col("ts") + ((FIRST, SECOND)[k] - newest[k]))
            rows.repartition(spark.sparkContext.defaultParallelism).write.parquet(f"{root}/{name}")

        def once(now: float) -> None:
            options = runs.Options(now=now, windows=WINDOWS, feed_format="parquet", batch_files=1000, keep_days=4)
            runs.once(spark, settings, f"{root}/in*", data, lambda r: True, options, lambda r: True)

        come(0, "in0")
        store.together(lambda s: once(FIRST), lambda s: come(1, "later"))
        store.rename(f"{root}/later", f"{root}/in1")
        once(SECOND)
        _done[key] = data
    return Store(spark, f"{_done[key]}/state"), _done[key]


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, *state(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = BASE + sql
        return f

    return add


#: The runs in SQL: m, messages of each run; j, items with reasons; i, items kept, one for each key; the first run has r = 0.
BASE = r"""WITH h AS (SELECT max(event_id) // 2 AS half FROM events),
e AS (SELECT 0 AS r, e.* FROM events e, h WHERE event_id < half UNION ALL SELECT 1, e.* FROM events e, h WHERE event_id >= half * 4 // 5),
m AS (SELECT r, 's' || event_id % 5 AS source_id, event_id % 5 AS s, event_id + 1 AS id, epoch_us(ts) / 1e6 - max(epoch_us(ts) / 1e6) OVER (PARTITION BY r) AS age, 'c' || user_id % 3 AS chat_id, event_type AS kind, event_id AS k, user_id AS u, props FROM e),
f AS (SELECT *, CASE kind WHEN 'click' THEN 'vless://u' || k % 200 || '@h.example.com:443#x' || k WHEN 'view' THEN 'seen' WHEN 'purchase' THEN props WHEN 'signup' THEN CASE WHEN s < 2 THEN 'trojan://s' || u % 30 || '@t.example.com:8443' END END AS body,
  CASE kind WHEN 'error' THEN 'e' || u % 40 || CASE WHEN u % 10 = 0 THEN '.Apk' ELSE '.conf' END WHEN 'purchase' THEN 'p' || u % 5 || '.ovpn' END AS file_name,
  CASE kind WHEN 'error' THEN 'line ' || k % 50 || E'\n# c\nline ' || u WHEN 'purchase' THEN props END AS data FROM m WHERE s < 4),
o AS (SELECT s, max(id) AS last FROM f WHERE r = 0 GROUP BY s),
c AS (SELECT f.*, coalesce(last, 0) AS last, true AS is_text, id || CASE WHEN f.s < 2 THEN '_text' ELSE '' END AS external_id, 'msg_' || id || '.txt' AS filename, body AS content, f.s < 2 AND file_name IS NOT NULL AS as_file FROM f LEFT JOIN o ON f.s = o.s AND r = 1 WHERE body IS NOT NULL
  UNION ALL SELECT f.*, coalesce(last, 0), false, id || CASE WHEN f.s < 2 THEN '' ELSE '_media' END, file_name, data, true FROM f LEFT JOIN o ON f.s = o.s AND r = 1 WHERE file_name IS NOT NULL),
j AS (SELECT *, CASE WHEN id <= last THEN 'offset' WHEN s = 1 AND chat_id <> 'c0' THEN 'chat' WHEN kind = 'view' THEN 'media' WHEN last = 0 AND age < -3600.0 * CASE WHEN as_file THEN 240 ELSE 72 END THEN 'old'
  WHEN NOT is_text AND lower(filename) LIKE '%.apk' THEN 'apk' WHEN NOT is_text AND kind = 'error' AND k % 9 = 0 THEN 'size' END AS reason FROM c),
i AS (SELECT *, sha256(content) AS raw_hash, CASE WHEN filename LIKE '%.conf' THEN 'conf_lines' WHEN filename LIKE '%.ovpn' THEN 'ovpn' WHEN content LIKE '%://%' THEN 'npvt' ELSE 'opaque_bundle' END AS fmt FROM j WHERE reason IS NULL),
st AS (SELECT r, raw_hash, source_id, s, min(filename) AS filename, any_value(content) AS content FROM (SELECT *, min(r) OVER (PARTITION BY raw_hash, source_id) AS r0 FROM i) WHERE r = r0 GROUP BY ALL),
sf AS (SELECT *, CASE WHEN filename LIKE '%.conf' THEN 'conf_lines' WHEN filename LIKE '%.ovpn' THEN 'ovpn' WHEN content LIKE '%://%' THEN 'npvt' ELSE 'opaque_bundle' END AS fmt FROM st),
su AS (SELECT *, CASE WHEN s = 1 AND fmt <> 'npvt' THEN 'ignored' ELSE 'processed' END AS status FROM sf),
rec AS (SELECT DISTINCT r, raw_hash, fmt, content FROM su WHERE status = 'processed'),
rf AS (SELECT DISTINCT CASE WHEN s = 3 THEN 'few' ELSE 'all' END AS route, r, raw_hash FROM su),
a AS (SELECT DISTINCT route, rf.r, rec.raw_hash, fmt, content FROM rf JOIN rec ON rf.raw_hash = rec.raw_hash AND rec.r <= rf.r WHERE (route = 'all' AND fmt <> 'opaque_bundle') OR (route = 'few' AND fmt IN ('npvt', 'opaque_bundle'))),
n AS (SELECT DISTINCT route, r, regexp_replace(content, '#.*', '') AS uri FROM a WHERE fmt = 'npvt')
"""


@query("SELECT r AS run, source_id, coalesce(reason, 'kept') AS reason, count(*) AS n FROM j GROUP BY ALL")
def run_skip_reasons(spark, store, data):
    s = store.read("skips", SKIPS)
    first = s.agg(F.min("run").alias("first"))
    return s.join(F.broadcast(first)).groupBy((F.col("run") > F.col("first")).cast("int").alias("run"), "source_id", "reason").agg(F.sum("n").alias("n"))  # one row


@query("SELECT source_id, external_id, filename, raw_hash, length(content)::BIGINT AS file_size, is_text FROM i")
def run_seen_files(spark, store, data):
    return store.read("seen_files", SEEN_FILES).select("source_id", "external_id", "filename", "raw_hash", "file_size", F.get_json_object("metadata_json", "$.is_text").cast("boolean").alias("is_text"))


@query("""SELECT f.source_id, CASE WHEN s < 2 THEN 'telegram' ELSE 'telegram_user' END AS source_type, max(id) AS last, (SELECT count(*) FROM i WHERE i.s = f.s) AS total_files, (SELECT count(*) FROM i WHERE i.s = f.s AND r = 1) AS files_ingested,
(SELECT coalesce(sum(length(content)), 0)::BIGINT FROM i WHERE i.s = f.s AND r = 1) AS bytes_ingested, (SELECT count(*) FROM i WHERE i.s = f.s AND r = 1 AND is_text) AS text_items, 1800400000 AS updated_at FROM f GROUP BY ALL""")
def run_source_state(spark, store, data):
    s = store.read("source_state", SOURCE_STATE)
    last = "state.stats.last_run"
    return s.select("source_id", "source_type", F.col("state.offset").alias("last"), "state.stats.total_files", f"{last}.files_ingested", f"{last}.bytes_ingested", f"{last}.text_items", "updated_at")


@query("SELECT raw_hash, source_id, fmt, status, CASE WHEN status = 'ignored' THEN 'Format ' || fmt || ' not allowed' END AS error_msg FROM su")
def run_file_statuses(spark, store, data):
    return store.read("status", STATUS).select("raw_hash", "source_id", "fmt", "status", "error_msg")


@query("""SELECT record_type, unique_hash, count(*) AS n FROM (
SELECT DISTINCT r, raw_hash, 'npvt' AS record_type, sha256(regexp_replace(content, '#.*', '')) AS unique_hash FROM su WHERE fmt = 'npvt' AND status = 'processed'
UNION ALL SELECT DISTINCT r, raw_hash, 'conf_lines', sha256(l) FROM (SELECT r, raw_hash, unnest(string_split(content, E'\\n')) AS l FROM su WHERE fmt = 'conf_lines' AND status = 'processed') WHERE l NOT LIKE '#%'
UNION ALL SELECT r, raw_hash, fmt, raw_hash FROM su WHERE fmt IN ('ovpn', 'opaque_bundle') AND status = 'processed') GROUP BY 1, 2""")
def run_records(spark, store, data):
    return store.read("records", RECORDS).groupBy("record_type", "unique_hash").agg(F.count("*").alias("n"))


@query("SELECT route, count(DISTINCT uri) AS uris, sum(CASE WHEN uri LIKE 'vless%' THEN 1 ELSE 0 END)::BIGINT AS vless, sum(CASE WHEN uri LIKE 'trojan%' THEN 1 ELSE 0 END)::BIGINT AS trojan FROM n WHERE r = 1 GROUP BY 1")
def run_uri_outputs(spark, store, data):
    """The URI lists of the second run: numbers by scheme go from 1 without gaps, and lines without them are distinct."""
    f = listing(spark, f"{data}/output").where(F.col("name").endswith(".npvt"))
    lines = f.select(F.regexp_extract("name", r"^([^.]*)\.", 1).alias("route"), F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line"))
    parts = lines.select("route", F.substring_index("line", "#", 1).alias("uri"), F.substring_index("line", "://", 1).alias("scheme"), F.regexp_extract("line", "-([0-9]+)$", 1).cast("int").alias("k"))
    per = parts.groupBy("route", "scheme").agg(F.count("*").alias("n"), F.countDistinct("uri").alias("u"), F.max("k").alias("k"), F.countDistinct("k").alias("ks")).where("n = u and n = k and n = ks")
    count = lambda s: F.coalesce(F.sum(F.when(F.col("scheme") == s, F.col("n"))), F.lit(0))
    return per.groupBy("route").agg(F.sum("n").alias("uris"), count("vless").alias("vless"), count("trojan").alias("trojan"))


@query("""SELECT unnest(CASE WHEN fmt = 'npvt' THEN [route || '.npvt', route || '_npvt_b64sub.txt', route || '_npvt_decoded.json'] ELSE [route || '.' || fmt] END) AS name FROM (SELECT DISTINCT route, fmt FROM a WHERE r = 1)""")
def run_output_names(spark, store, data):
    return listing(spark, f"{data}/output").where("size > 0").select("name")


@query("""SELECT route || '.' || fmt AS name, count(*) AS entries, sum(length(content))::BIGINT AS bytes FROM a WHERE r = 1 AND fmt IN ('ovpn', 'opaque_bundle') GROUP BY 1""")
def run_zip_outputs(spark, store, data):
    return zip_entries(listing(spark, f"{data}/output").where(F.col("name").rlike(r"\.(ovpn|opaque_bundle)$"))).select("name", "entries", "bytes")


@query("SELECT route || '_npvt_decoded.json' AS name, string_split(uri, '://')[1] AS protocol, count(DISTINCT uri) AS n FROM n WHERE r = 1 GROUP BY ALL")
def run_decoded_documents(spark, store, data):
    docs = listing(spark, f"{data}/output").where(F.col("name").endswith("decoded.json")).select("name", F.decode("content", "UTF-8").alias("text"))
    return document_protocols(docs)


@query("""SELECT unique_id, count(*) AS n FROM (SELECT unnest(CASE WHEN fmt = 'npvt' THEN ['all:npvt', 'all:npvt.b64sub', 'all:npvt.decoded.json'] ELSE ['all:' || fmt] END) AS unique_id FROM (SELECT DISTINCT r, fmt FROM a WHERE route = 'all')) GROUP BY ALL""")
def run_published(spark, store, data):
    return store.read("published", PUBLISHED).groupBy("unique_id").agg(F.count("*").alias("n"))


@query("SELECT user_id, 'npvt' AS default_format, user_id % 4 = 0 AS muted, CASE WHEN user_id % 4 > 0 THEN 1800400000.0::DOUBLE END AS last_delivered_at FROM (SELECT unnest(range(20)) AS user_id)")
def run_user_deliveries(spark, store, data):
    return store.read("users", USERS).select(F.col("user_id").cast("bigint").alias("user_id"), "default_format", "muted", "last_delivered_at")


@query("SELECT uri, min(CASE WHEN r = 0 THEN 1800000000.0 ELSE 1800400000.0 END)::DOUBLE AS first_seen FROM (SELECT r, regexp_replace(content, '#.*', '') AS uri FROM su WHERE fmt = 'npvt' AND status = 'processed') GROUP BY 1")
def run_manifest(spark, store, data):
    return store.read("manifest", MANIFEST)


@query("""SELECT pos, uri || '#' || string_split(uri, '://')[1] || '-' || row_number() OVER (PARTITION BY string_split(uri, '://')[1] ORDER BY pos) AS line FROM (SELECT uri, row_number() OVER (ORDER BY first DESC, uri) AS pos FROM
(SELECT regexp_replace(content, '#.*', '') AS uri, min(CASE WHEN r = 0 THEN 1 ELSE 2 END) AS first FROM su WHERE fmt = 'npvt' AND status = 'processed' GROUP BY 1))""")
def run_history_file(spark, store, data):
    """The lines of the all-time list below its heading, with their places."""
    text = listing(spark, f"{data}/history").where("name = 'proxies.txt'").select(F.split(F.decode("content", "UTF-8"), "\n").alias("l"))
    return text.select(F.posexplode(F.slice("l", 5, F.size("l") - 5)).alias("pos", "line")).select((F.col("pos") + 1).cast("bigint").alias("pos"), "line")


@query("""SELECT count(*) AS files, count(DISTINCT type) AS types FROM (SELECT unnest(CASE WHEN fmt = 'npvt' THEN ['NPVT', 'TXT', 'JSON'] ELSE [upper(fmt)] END) AS type FROM (SELECT DISTINCT route, fmt FROM a WHERE r = 1))""")
def run_catalog(spark, store, data):
    doc = F.from_json("value", "struct<total_files:bigint,total_size:bigint,files:array<struct<type:string,size:bigint>>>")
    c = spark.read.text(f"{data}/catalog.json").select(doc.alias("d"))
    same = F.aggregate("d.files", F.lit(0).cast("bigint"), lambda a, f: a + f["size"]) == F.col("d.total_size")
    return c.where(same).select(F.col("d.total_files").alias("files"), F.size(F.array_distinct(F.transform("d.files", lambda f: f["type"]))).cast("bigint").alias("types"))


@query("""SELECT unnest(CASE WHEN fmt = 'npvt' THEN [route || '_1800400000.npvt', route || '_1800400000.npvt.b64sub', route || '_1800400000.npvt.decoded.json'] ELSE [route || '_1800400000.' || fmt] END) AS name FROM (SELECT DISTINCT route, fmt FROM a WHERE r = 1)""")
def run_archive(spark, store, data):
    """The dated copies that four days leave, newest first; those of the first run are gone."""
    return recent(dated(listing(spark, f"{data}/archive")), F.timestamp_seconds(F.lit(SECOND))).select("name")


@query("SELECT DISTINCT raw_hash FROM su WHERE status = 'processed'")
def run_kept_blobs(spark, store, data):
    return store.read("blobs", BLOBS).select("raw_hash")


@query("""SELECT fmt AS record_type, count(*) AS n, sum(length(content))::BIGINT AS bytes FROM su WHERE status = 'processed' AND fmt IN ('ovpn', 'opaque_bundle') GROUP BY 1""")
def run_blob_lookup(spark, store, data):
    """The bundles' records with the contents that they refer to."""
    r = store.read("records", RECORDS).where("data.blob_hash is not null").select("record_type", F.col("data.blob_hash").alias("blob_hash"))
    return blob_lookup(r, store.read("blobs", BLOBS)).groupBy("record_type").agg(F.count("content").alias("n"), F.sum(F.octet_length("content")).cast("bigint").alias("bytes"))


@query("SELECT 0 AS pending, 0 AS removable, 2 AS batches")
def run_is_done(spark, store, data):
    """Nothing is left to do, and each batch is one transaction."""
    tags = [t for t in store.commits().values() if t.startswith("batch-")]
    count = lambda df: df.agg(F.count("*").cast("int").alias("n"))
    both = count(runs.pending(store)).select(F.col("n").alias("pending")).join(count(runs.removable(store)).select(F.col("n").alias("removable")))  # one row each
    return both.withColumn("batches", F.lit(len(tags)))
