"""URL filter against a dated list (DataFrame functions only).

List entries (pattern, verdict, listed_at) become validity intervals: an entry holds from its date until the next
entry of the same pattern; verdict 'none' takes a pattern off the list. A pattern is a host or a parent domain
('a.example.com', 'example.com'), or a host with leading path segments ('a.example.com/x/y'). An as-of join then
evaluates every capture against the entries active when it was fetched; of those, the longest pattern with a path
wins, else the longest domain.

Hosts are read as browsers do: blanks before the URL, a missing scheme ('//host/'), '\\' for '/', all up to the last
'@', ports and dots at the end don't disguise a host. Paths are compared to the depth of the list's deepest pattern.

The interval side of the join is repeated over `salts` values and captures are dealt to one of them, so that a host
with a third of all captures is split; the list is small beside the captures.

Nulls: a capture whose url or time is null matches nothing ('pass'); entries with a null pattern or date are
ignored. Ties: of entries for one pattern and moment, the greatest verdict in code point order holds. Repeated
captures give one row. Empty inputs give 'pass' for all, or no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .shared import table

AUTHORITY = r"^[\x00-\x20]*(?:[A-Za-z][A-Za-z0-9+.-]*:)?[/\\]{2}([^/\\?#]*)"
PATH = r"^[\x00-\x20]*(?:[A-Za-z][A-Za-z0-9+.-]*:)?[/\\]{2}[^/\\?#]*([/\\][^?#]*)"
HOST = r"^(?:.*@)?(\[[^\]]*\]|[^:]*?)\.*(?::.*)?$"


def validity(entries: DataFrame) -> DataFrame:
    """pattern, verdict, valid_from, valid_to (exclusive, null: open)."""
    one = entries.where("pattern is not null and listed_at is not null").groupBy("pattern", "listed_at").agg(F.max("verdict").alias("verdict"))
    following = F.lead("listed_at").over(W.partitionBy("pattern").orderBy("listed_at"))
    return one.select("pattern", "verdict", F.col("listed_at").alias("valid_from"), following.alias("valid_to")).where("verdict <> 'none'")


def with_host(df: DataFrame, url: str = "url") -> DataFrame:
    return df.withColumn("host", F.nullif(F.lower(F.regexp_extract(F.regexp_extract(url, AUTHORITY, 1), HOST, 1)), F.lit("")))


def filter_urls(captures: DataFrame, entries: DataFrame, salts: int = 16) -> DataFrame:
    """captures: page_id, url, fetched_at. One row for each distinct capture: page_id, url, fetched_at, host,
    verdict ('block', 'allow', 'pass'), pattern, valid_from, n_active."""
    depth = entries.agg(F.coalesce(F.max(F.size(F.split("pattern", "/")) - 1), F.lit(0))).first()[0]
    c = with_host(captures.select("page_id", "url", "fetched_at"))
    labels, segments = F.split("host", r"\."), F.filter(F.split(F.regexp_extract("url", PATH, 1), r"[/\\]"), lambda x: x != "")
    c = c.withColumns({"labels": labels, "segments": F.coalesce(segments, F.array().cast("array<string>"))})
    c = c.withColumn("domains", F.expr("transform(sequence(1, greatest(size(labels) - 1, 1)), i -> concat_ws('.', slice(labels, i, size(labels))))"))
    c = c.withColumn("paths", F.expr(f"if(size(segments) = 0 or {depth} = 0, array(), transform(sequence(1, least(size(segments), {depth})), i -> concat(host, '/', concat_ws('/', slice(segments, 1, i)))))"))
    keys = F.when(F.col("host").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.array_distinct(F.concat("domains", "paths")))
    c = c.select("page_id", "url", "fetched_at", "host", F.explode(keys).alias("key"))
    c = c.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    v = validity(entries).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    active = (c.key == v.pattern) & (c.salt == v.salt) & (c.fetched_at >= v.valid_from) & (v.valid_to.isNull() | (c.fetched_at < v.valid_to))
    j = c.join(v, active, "left").drop(v.salt)
    best = F.max(F.when(F.col("pattern").isNotNull(), F.struct(F.contains("pattern", F.lit("/")).alias("path"), F.length("pattern").alias("n"), "pattern", "verdict", "valid_from")))
    out = j.groupBy("page_id", "url", "fetched_at", "host").agg(best.alias("b"), F.size(F.collect_set("pattern")).cast("bigint").alias("n_active"))
    return out.select("page_id", "url", "fetched_at", "host", F.coalesce("b.verdict", F.lit("pass")).alias("verdict"), "b.pattern", "b.valid_from", "n_active")


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages carry no time of fetching; one is made of the id, in minutes of 2024."""
    minutes = F.pmod(F.col("page_id") * 7919, F.lit(525600))
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + minutes * 60).cast("timestamp_ntz").alias("fetched_at"))


def page_list(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of the pages, made by rule: there is no table of list entries."""
    h = with_host(pages).where("host is not null").select("host").distinct()
    h = h.withColumn("x", F.pmod(F.length("host") * 31 + F.ascii("host") * 17 + F.ascii(F.substring("host", 3, 1)) * 7 + F.ascii(F.substring("host", 7, 1)) * 3, F.lit(1000)))
    at = lambda days: F.timestamp_seconds(F.lit(1704067200) + days * 86400).cast("timestamp_ntz")
    of = lambda df, pattern, verdict, days: df.select(pattern.alias("pattern"), F.lit(verdict).alias("verdict"), at(days).alias("listed_at"))
    host, x = F.col("host"), F.col("x")
    parts = [
        of(h.where(x % 3 == 0), host, "block", x % 300),
        of(h.where(x % 6 == 0), host, "none", x % 300 + 5 + x % 7 * 10),
        of(h.where(x % 12 == 0), host, "block", x % 300 + 150),
        of(h.where(host.rlike("casino|bets|pills|adult")), host, "block", F.lit(0)),
        of(h.where(x % 5 == 0), F.concat(host, F.lit("/en")), "allow", F.lit(100)),
        of(h.where(x % 10 == 0), F.concat(host, F.lit("/en")), "none", F.lit(200)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(page_captures(pages), page_list(pages))


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_minutes(((page_id * 7919) % 525600)::INT) AS fetched_at,
    nullif(lower(regexp_extract(regexp_extract(url, '^[\x00-\x20]*(?:[A-Za-z][A-Za-z0-9+.-]*:)?[/\\]{2}([^/\\?#]*)', 1), '^(?:.*@)?(\[[^\]]*\]|[^:]*?)\.*(?::.*)?$', 1)), '') AS host,
    list_filter(regexp_split_to_array(regexp_extract(url, '^[\x00-\x20]*(?:[A-Za-z][A-Za-z0-9+.-]*:)?[/\\]{2}[^/\\?#]*([/\\][^?#]*)', 1), '[/\\]'), lambda s: s <> '') AS segs
  FROM pages),
h AS (
  SELECT host, (length(host) * 31 + ascii(host) * 17 + ascii(substr(host, 3, 1)) * 7 + ascii(substr(host, 7, 1)) * 3) % 1000 AS x
  FROM (SELECT DISTINCT host FROM p WHERE host IS NOT NULL)),
e AS (
  SELECT host AS pattern, 'block' AS verdict, x % 300 AS d FROM h WHERE x % 3 = 0
  UNION ALL SELECT host, 'none', x % 300 + 5 + x % 7 * 10 FROM h WHERE x % 6 = 0
  UNION ALL SELECT host, 'block', x % 300 + 150 FROM h WHERE x % 12 = 0
  UNION ALL SELECT host, 'block', 0 FROM h WHERE regexp_matches(host, 'casino|bets|pills|adult')
  UNION ALL SELECT host || '/en', 'allow', 100 FROM h WHERE x % 5 = 0
  UNION ALL SELECT host || '/en', 'none', 200 FROM h WHERE x % 10 = 0),
v AS (
  SELECT pattern, verdict, TIMESTAMP '2024-01-01' + to_days(d::INT) AS valid_from,
    lead(TIMESTAMP '2024-01-01' + to_days(d::INT)) OVER (PARTITION BY pattern ORDER BY d) AS valid_to
  FROM (SELECT pattern, d, max(verdict) AS verdict FROM e GROUP BY ALL)),
k AS (
  SELECT DISTINCT page_id, url, fetched_at, host,
    unnest(list_concat(
      list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1)::BIGINT + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
      list_transform(range(1, least(len(segs), 3) + 1), lambda i: host || '/' || array_to_string(segs[1:i], '/')))) AS key
  FROM p),
m AS (
  SELECT k.page_id, k.url, k.fetched_at, v.pattern, v.verdict, v.valid_from,
    row_number() OVER (PARTITION BY k.page_id, k.url, k.fetched_at ORDER BY contains(v.pattern, '/') DESC, length(v.pattern) DESC, v.pattern DESC) AS r,
    count(*) OVER (PARTITION BY k.page_id, k.url, k.fetched_at) AS n
  FROM k JOIN v ON k.key = v.pattern AND k.fetched_at >= v.valid_from AND (v.valid_to IS NULL OR k.fetched_at < v.valid_to)
  WHERE v.verdict <> 'none')
SELECT DISTINCT p.page_id, p.url, p.fetched_at, p.host, coalesce(m.verdict, 'pass') AS verdict, m.pattern, m.valid_from, coalesce(m.n, 0)::BIGINT AS n_active
FROM p LEFT JOIN m ON p.page_id = m.page_id AND p.url IS NOT DISTINCT FROM m.url AND p.fetched_at = m.fetched_at AND m.r = 1
"""
