"""Counts, totals, facets and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.naming import human_size


def user_stats(users: DataFrame) -> DataFrame:
    total, active = F.count("*"), F.count_if(~F.coalesce(F.col("muted"), F.lit(False)))
    return users.agg(total.alias("total"), active.alias("active"), (total - active).alias("muted"))


def ingest_stats(items: DataFrame) -> DataFrame:
    """items: source_id, is_new, is_text, bytes. Counts and sizes of a run, for each source."""
    new, text = F.col("is_new"), F.col("is_text")
    size = F.coalesce(F.sum(F.when(new, F.col("bytes"))), F.lit(0))
    return items.groupBy("source_id").agg(
        F.count_if(new).alias("files_ingested"), F.count_if(~new).alias("skipped_files"), size.alias("bytes_ingested"),
        F.count_if(new & text).alias("text_items"), F.count_if(new & ~text).alias("media_items"), F.avg(F.when(new, F.col("bytes"))).alias("avg_bytes"),
    )


def counts(df: DataFrame, by: str, name: str = "n") -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias(name))


def top(df: DataFrame, by: str, n: int = 10, name: str = "n") -> DataFrame:
    return counts(df, by, name).orderBy(F.desc(name), F.asc(by)).limit(n)


def document(entries: DataFrame) -> DataFrame:
    """entries: protocol. total, and protocols as a map of counts with keys in order."""
    per = counts(entries, "protocol")
    pairs = F.array_sort(F.collect_list(F.struct("protocol", "n")))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.map_from_entries(pairs).alias("protocols"))


def catalog_totals(files: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum("size"), F.lit(0))
    return files.agg(F.count("*").alias("total_files"), total.alias("total_size")).withColumn("total_size_str", human_size(F.greatest("total_size", F.lit(0))))


def facets(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.array_sort(F.collect_set(column)).alias("types"))


def first_tags(tags: Column, n: int = 4) -> Column:
    """The tags that are shown."""
    return F.slice(tags, 1, n)


#: Weights of the fields that a catalog search looks at.
SEARCH = {"filename": 0.7, "tags": 0.5, "type": 0.3, "ext": 0.2}


def search(files: DataFrame, words: str, kind: str = "ALL", order: str = "date_desc", threshold: float = 0.3) -> DataFrame:
    """Catalog rows near to the words, of one type, sorted. A field's distance is 0 where it contains the words, else the
    least share of letters to change in any of its words, or of runs of as many words as are asked for; a field of less
    weight adds to its distance. Rows stay whose best field is within the threshold."""
    rows, q = files, words.strip().lower()
    if kind != "ALL":
        rows = rows.where(F.col("type") == kind)
    if q:
        kinds, n = dict(files.dtypes), len(q.split())

        def distance(name: str):
            text = F.lower(F.array_join(name, " ") if kinds[name].startswith("array") else F.coalesce(F.col(name), F.lit("")))
            parts = F.filter(F.split(text, r"(?U)[^\w]+"), lambda x: x != "")
            runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - n, F.lit(0))), lambda i: F.array_join(F.slice(parts, i + 1, n), " "))
            near = F.array_min(F.transform(runs, lambda x: F.levenshtein(x, F.lit(q)) / F.greatest(F.length(x), F.lit(len(q)))))
            return F.when(F.contains(text, F.lit(q)), 0.0).otherwise(F.coalesce(near, F.lit(1.0)))

        top = max(SEARCH.values())
        score = F.least(*(distance(c) + (top - w) * 0.1 for c, w in SEARCH.items() if c in files.columns), F.lit(1.0))
        rows = rows.withColumn("score", score).where(F.col("score") <= threshold)
    keys = {"date_desc": [F.desc("last_modified")], "date_asc": [F.asc("last_modified")], "name_asc": [F.collate("filename", "UNICODE")], "size_desc": [F.desc("size")]}
    return rows.orderBy(*keys[order], F.asc("filename"))
