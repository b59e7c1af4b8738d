"""Files as tables: state snapshots, blobs, archives, ZIP contents, decoded documents."""

from __future__ import annotations

import copy
import io
import os
import threading
import uuid
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema


class Store:
    """State tables under a root, changed by transactions. A transaction writes folders, <kind><number>-<k> for each
    table that it touches: v is a whole snapshot, a adds rows to what is before it; then one file in _commits makes all
    of them count at once. What a broken transaction left is no part of any table, and is deleted by the next one.
    Readers of older folders are undisturbed. Paths may be on any file system that Spark reads; one writer at a time:
    transactions of steps that run together wait for each other."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.open: int | None = None
        self.lock = threading.Lock()

    def together(self, *steps: Callable[[Store], object]) -> None:
        """Steps that don't need each other, at the same time, each with a store of its own; within a transaction they are
        part of it. All come to their end; then the first error is raised."""
        context = self.spark.sparkContext._jsc.sc()

        def go(step: Callable[[Store], object], properties) -> None:
            context.setLocalProperties(properties)
            step(copy.copy(self))

        with ThreadPoolExecutor(len(steps)) as pool:
            going = [pool.submit(go, step, context.getLocalProperties().clone()) for step in steps]
        for x in going:
            x.result()

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def rename(self, path: str, to: str) -> None:
        fs, p = self._fs(path)
        if not fs.rename(p, self._fs(to)[1]):
            raise OSError(f"{path} can't be renamed")

    def commits(self) -> dict[int, str]:
        """Numbers and tags of the transactions that count."""
        return {int(x[:8]): x[9:] for x in self._names(f"{self.root}/_commits") if x[:8].isdigit()}

    def tagged(self, tag: str) -> int | None:
        """The transaction of that tag."""
        return min((n for n, t in self.commits().items() if tag and t == tag), default=None)

    @contextmanager
    def transaction(self, tag: str = "") -> Iterator[int]:
        """Its number; one within another is part of it. Nothing counts if the block raises."""
        if self.open is not None:
            yield self.open
            return
        with self.lock:
            n = max(self.commits(), default=-1) + 1
            for name in (x for x in self._names(self.root) if x[0] != "_"):
                for x in self._names(f"{self.root}/{name}"):
                    if _number(x) >= n:
                        self.drop(f"{name}/{x}")
            self.open = n
            try:
                yield n
                fs, p = self._fs(f"{self.root}/_commits/{n:08d}-{tag}")
                fs.create(p, False).close()
            finally:
                self.open = None

    def folders(self, name: str) -> list[str]:
        """The folders that make up the table: the last snapshot and what was added since."""
        done = self.commits().keys() | ({self.open} if self.open is not None else set())
        names = sorted((x for x in self._names(f"{self.root}/{name}") if _number(x) in done), key=lambda x: x[1:])
        base = max((i for i, x in enumerate(names) if x[0] == "v"), default=0)
        return names[base:]

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        found = self.folders(name)
        if not found:
            return table(self.spark, [], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{name}/{x}" for x in found))

    def _write(self, name: str, df: DataFrame, kind: str) -> None:
        with self.transaction() as n:
            k = sum(_number(x) == n for x in self._names(f"{self.root}/{name}"))
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/{kind}{n:08d}-{k:04d}")

    def append(self, name: str, df: DataFrame) -> None:
        self._write(name, df, "a")

    def replace(self, name: str, df: DataFrame) -> None:
        """A new snapshot; df may read the table itself."""
        self._write(name, df, "v")

    @contextmanager
    def kept(self, df: DataFrame) -> Iterator[DataFrame]:
        """df written once, for what reads it several times: it is neither computed nor planned again. Deleted at the end."""
        name = f"_scratch/{uuid.uuid4().hex}"
        try:
            df.write.parquet(f"{self.root}/{name}")
            yield self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")
        finally:
            self.drop(name)

    def compact(self, name: str, schema: T.StructType, most: int = 32) -> None:
        """One folder instead of more than `most`."""
        if len(self.folders(name)) > most:
            self.replace(name, self.read(name, schema))

    def drop(self, name: str | None = None) -> None:
        """Deletes a table, or all of them."""
        fs, p = self._fs(f"{self.root}/{name}" if name else self.root)
        fs.delete(p, True)


def _number(folder: str) -> int:
    return int(folder[1:9]) if folder[1:9].isdigit() else -1


def table(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """A few rows as a table that Spark knows to be small, or empty; of what createDataFrame() makes of a list, it doesn't."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not rows:
        return spark.createDataFrame([], kind).where(F.lit(False))
    columns = to_arrow_schema(kind)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), columns)], schema=columns), kind)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder: path, name, modified, size, content; content is read only where it is used."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return df.select("path", F.substring_index("path", "/", -1).alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def dated(files: DataFrame) -> DataFrame:
    """Archived copies by the time in their names, which moving files doesn't change."""
    told = F.regexp_extract("name", r"_([0-9]{9,11})\.", 1)
    return files.withColumn("modified", F.when(told != "", F.timestamp_seconds(told.try_cast("bigint"))).otherwise(F.col("modified")))


def recent(files: DataFrame, now: Column, days: int = 4) -> DataFrame:
    """Archived files of the last days, newest first."""
    return files.where(F.col("modified") >= now - F.make_interval(days=F.lit(days))).orderBy(F.desc("modified"), "name")


def expired(files: DataFrame, now: Column, days: int = 4) -> DataFrame:
    return files.where(F.col("modified") < now - F.make_interval(days=F.lit(days)))


def zip_entries(files: DataFrame) -> DataFrame:
    """name and content of files; entries, bytes uncompressed, and the numbers of extensions of each ZIP; null for others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content in batch.column(1):
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py() or b"")) as z:
                        infos = z.infolist()
                    exts = Counter(os.path.splitext(i.filename)[1].lower() for i in infos)
                    rows.append((len(infos), sum(i.file_size for i in infos), sorted(exts.items())))
                except zipfile.BadZipFile:
                    rows.append((None, None, None))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.map_(pa.string(), pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["name", "entries", "bytes", "extensions"])

    return files.select("name", "content").mapInArrow(run, "name string, entries bigint, bytes bigint, extensions map<string,bigint>")


def zip_listing(files: DataFrame) -> DataFrame:
    """name and content of ZIPs; a row for each entry: name, entry, size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    infos = z.infolist()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(infos), pa.string()), pa.array([i.filename for i in infos], pa.string()), pa.array([i.file_size for i in infos], pa.int64())], ["name", "entry", "size"])

    return files.select("name", "content").mapInArrow(run, "name string, entry string, size bigint")


def document_protocols(documents: DataFrame) -> DataFrame:
    """documents: name, text (a decoded document in JSON). Numbers of entries by protocol."""
    entries = F.from_json("text", "struct<entries:array<struct<protocol:string>>>")["entries"]
    return documents.select("name", F.explode(entries).alias("e")).groupBy("name", "e.protocol").agg(F.count("*").alias("n"))


def blob_lookup(records: DataFrame, blobs: DataFrame, key: str = "blob_hash") -> DataFrame:
    """records with content; null where the blob is missing."""
    return records.join(blobs.withColumnRenamed("raw_hash", key), key, "left")
