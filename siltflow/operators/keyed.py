"""Keyed state: latest per key, first seen, insert-or-ignore, upsert, anti joins, numbering.

Latest and first rows are max_by/min_by aggregates: they combine before the shuffle, so a hot key costs one row a task,
where a window would sort the whole key in one task. Numbering needs an order and uses windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest order values of each key; one row a key, whatever joins came before."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*df.columns)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*df.columns)


def unseen(new: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows whose key isn't in seen yet."""
    return new.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def probed(df: DataFrame, known: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """df with whether each row's key is known."""
    there = known.select(*keys).distinct().withColumn(name, F.lit(True))
    return df.join(there, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def waiting(files: DataFrame, told: DataFrame, keys: Sequence[str], limit: int | None = None) -> DataFrame:
    """Files (id, keys) that nothing is told of, the first `limit` of them by id."""
    out = unseen(files, told, keys)
    return out if limit is None else out.orderBy("id").limit(limit)


def insert_ignore(seen: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """seen, and the first new row of each key that seen lacks."""
    return seen.unionByName(unseen(first_per_key(new, keys, order), seen, keys))


def upsert(state: DataFrame, changes: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """state with the latest change of each key; columns in keep are set on insert and not updated."""
    new = latest_per_key(changes, keys, order)
    j = state.alias("s").join(new.alias("n"), list(keys), "full_outer")
    hit = F.col(f"n.{order[0]}").isNotNull()
    pick = lambda c: F.coalesce(f"s.{c}", f"n.{c}") if c in keep else F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"s.{c}"))
    return j.select(*(F.col(c) if c in keys else pick(c).alias(c) for c in state.columns))


def set_status(files: DataFrame, updates: DataFrame, key: str = "raw_hash") -> DataFrame:
    """files with status and error_msg of updates; every file that shares the content changes."""
    u = latest_per_key(updates, [key], ["status"]).select(key, F.col("status").alias("_s"), F.col("error_msg").alias("_e"))
    j = files.join(u, key, "left")
    return j.select(*(F.coalesce("_s", c).alias(c) if c == "status" else F.when(F.col("_s").isNotNull(), F.col("_e")).otherwise(F.col(c)).alias(c) if c == "error_msg" else F.col(c) for c in files.columns))


def prunable(hashes: DataFrame, records: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """Distinct raw_hash values with no records of theirs, nor pending files if those are given."""
    out = hashes.select("raw_hash").distinct().join(records.select(F.col("source_file_hash").alias("raw_hash")).distinct(), "raw_hash", "left_anti")
    return out if pending is None else out.join(pending.select("raw_hash").distinct(), "raw_hash", "left_anti")


def watermark(df: DataFrame, column: str) -> DataFrame:
    """The greatest id, 0 for none."""
    return df.agg(F.coalesce(F.max(column), F.lit(0)).alias("cutoff"))


def first_seen(manifest: DataFrame, uris: DataFrame, now: Column) -> DataFrame:
    """manifest (uri, first_seen) with the uris that it lacks, seen now; known ones keep their time."""
    return manifest.join(uris.select("uri").distinct(), "uri", "full_outer").select("uri", F.coalesce("first_seen", now).alias("first_seen"))


def newest_first(manifest: DataFrame) -> DataFrame:
    return manifest.orderBy(F.desc("first_seen"), F.asc("uri"))


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "n", buckets: int = 256) -> DataFrame:
    """1, 2 ... within each value of `by`. Rows are dealt to ranges of the first order column, of about equal width between
    its least and its greatest value in the group, numbered within these, and moved on by the sizes of the ranges before,
    so a group is many tasks. Order columns are numbers or can be cast to them, the first one without nulls."""
    by, at = list(by), F.col(order[0]).cast("double")
    span = df.groupBy(*by).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    cell = F.least(F.floor((at - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * buckets), F.lit(buckets - 1))
    rows = _join_null_safe(df, span, by).withColumn("_b", F.coalesce(cell, F.lit(0))).drop("_lo", "_hi")
    sizes = rows.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(W.partitionBy(*by).orderBy("_b")) - F.col("_n")).drop("_n")
    rows = _join_null_safe(rows, before, [*by, "_b"])
    return rows.withColumn(name, F.col("_before") + F.row_number().over(W.partitionBy(*by, "_b").orderBy(*order))).drop("_b", "_before")


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on equal keys, nulls included, with left's key columns."""
    other = right.select(*(F.col(c).alias(f"_{i}_key") if c in keys else F.col(c) for i, c in enumerate(right.columns)))
    on = F.lit(True)
    for i, c in enumerate(right.columns):
        if c in keys:
            on &= F.col(c).eqNullSafe(F.col(f"_{i}_key"))
    return left.join(other, on).drop(*(f"_{i}_key" for i in range(len(right.columns))))


def collision_names(df: DataFrame, by: Sequence[str], name: str, order: Sequence[str]) -> DataFrame:
    """entry: for rows in order, the name, or the first of 1_name, 2_name ... that no row before has as its entry.

    Names can only meet if they are equal without numbers in front. Where all names of such a family are the same, the
    i-th further row has i; families of several names, so with a name like '1_a', are gone through one by one.
    """
    family = F.regexp_replace(name, "^(?:[1-9][0-9]*_)+", "")
    rows = df.withColumn("_f", family)
    of = W.partitionBy(*by, "_f")
    rows = rows.withColumn("_mixed", F.min(name).over(of) != F.max(name).over(of))
    i = F.row_number().over(of.orderBy(*order)) - 1
    same = rows.where("not _mixed").withColumn("entry", F.when(i == 0, F.col(name)).otherwise(F.concat_ws("_", i.cast("string"), F.col(name))))
    some = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*df.columns).alias("r"))))

    def add(entries, x):
        own = x["r"][name]
        numbers = F.sequence(F.lit(1), F.size(entries) + 1)
        free = F.filter(numbers, lambda n: ~F.array_contains(entries, F.concat_ws("_", n.cast("string"), own)))[0]
        return F.concat(entries, F.array(F.when(F.array_contains(entries, own), F.concat_ws("_", free.cast("string"), own)).otherwise(own)))

    mixed = rows.where("_mixed").groupBy(*by, "_f").agg(some.alias("rows"))
    mixed = mixed.select(F.explode(F.arrays_zip("rows", F.aggregate("rows", F.array().cast("array<string>"), add).alias("entry"))).alias("x"))
    return same.select(*df.columns, "entry").unionByName(mixed.select(*(F.col(f"x.rows.r.{c}").alias(c) for c in df.columns), F.col("x.entry").alias("entry")))


def changed(results: DataFrame, ledger: DataFrame) -> DataFrame:
    """Results whose hash isn't the last published one of their unique_id; ties in time go to the later ledger row."""
    last = ledger.groupBy("unique_id").agg(F.max_by("artifact_hash", F.struct("published_at", "id")).alias("last_hash"))
    return results.join(last, "unique_id", "left").where(~F.col("artifact_hash").eqNullSafe(F.col("last_hash"))).drop("last_hash")


def stale(existing: DataFrame, expected: DataFrame, routes: DataFrame) -> DataFrame:
    """Existing files (name) of any route (prefix) that aren't expected. Routes are configuration, so that side is small."""
    owned = existing.join(routes, F.startswith(existing.name, routes.route), "left_semi")
    return owned.join(expected.select("name"), "name", "left_anti")


def distinct_in_order(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The first place of each value: by, value, and its order columns."""
    first = F.min(F.struct(*order)).alias("_o")
    return df.groupBy(*by, value).agg(first).select(*by, value, *(F.col(f"_o.{c}").alias(c) for c in order))


def joined_lines(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str], sep: str = "\n") -> DataFrame:
    """text: the values of each group, in order. One group is one string, as an artifact is one file."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(rows, lambda r: r["_v"]), sep).alias("text"))


def joined_digest(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str], sep: str = "\n") -> DataFrame:
    """artifact_hash and n: the SHA-256 of what joined_lines() gives, and the number of values (no nulls). A group is
    sorted in one task, which spills, and goes through it as a stream: no text of a whole group is held anywhere."""
    by, schema = list(by), df.select(*by).schema.add("artifact_hash", "string").add("n", "long")
    end = sep.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, n, done, fields = None, None, 0, [], []
        for batch in batches:
            fields = [*list(batch.schema)[:-1], pa.field("artifact_hash", pa.string()), pa.field("n", pa.int64())]
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(len(by)))))
            for k, v in zip(keys, batch.column(len(by)).to_pylist()):
                if digest is None or k != key:
                    if digest is not None:
                        done.append((*key, digest.hexdigest(), n))
                    key, digest, n = k, hashlib.sha256(), 0
                digest.update((end if n else b"") + v)
                n += 1
            if done:
                yield rows(done, fields)
                done = []
        if digest is not None:
            yield rows([(*key, digest.hexdigest(), n)], fields)

    def rows(done: list[tuple], fields: list[pa.Field]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip((f.name for f in fields), r)) for r in done], pa.schema(fields))

    lines = df.repartition(*by).sortWithinPartitions(*by, *order).select(*by, F.encode(F.col(value), "UTF-8").alias("_v"))
    return lines.mapInArrow(run, schema)
