"""Message sources: a connector protocol, and a file-backed one as a Spark streaming source.

Live chat clients are out of scope. A folder of JSON lines stands for a source: each line is a message with an id;
offsets are ids, and a restart goes on from the checkpoint's offset.
"""

from __future__ import annotations

import bisect
import glob
import json
import os
import time
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..schemas import MESSAGES


class Connector(Protocol):
    def list_new(self, state: dict) -> Iterator[dict]: ...

    def get_state(self) -> dict: ...


def with_retries(call: Callable, tries: int = 6, wait: Callable[[int], float] = lambda n: float(2**n), sleep=time.sleep):
    """call(), again after errors of connections or time-outs, at most `tries` times, waiting 1, 2, 4 ... seconds."""
    for n in range(tries + 1):
        try:
            return call()
        except (ConnectionError, TimeoutError):
            if n == tries:
                raise
            sleep(wait(n))


def stepped_wait(n: int) -> float:
    """2, 2, 4, 4, 8, 8, 16, 16, 32, 32 ... seconds, for reconnecting."""
    return float(min(32, 2 ** (1 + n // 2)))


def pages(fetch: Callable[[int, int], list[dict]], offset: int, size: int = 100, sleep=time.sleep) -> Iterator[dict]:
    """Messages by ascending id above the offset, page after page until one is empty; fetch(offset, size) is tried again
    after errors, and a connection that still fails is taken up again, at the last id, up to ten times."""
    lost = 0
    while True:
        try:
            page = with_retries(lambda: fetch(offset, size), sleep=sleep)
        except ConnectionError:
            if lost == 10:
                raise
            sleep(stepped_wait(lost))
            lost += 1
            continue
        if not page:
            return
        for row in sorted(page, key=lambda r: r["id"]):
            offset = max(offset, row["id"])
            yield row


class FolderConnector:
    """Messages of a folder of JSON lines with ids above the offset, in order of ids, a page at a time; get_state() has
    the last one. What was read of a folder is shared by its connectors until its files change."""

    _read: dict[str, tuple[tuple, list[dict]]] = {}

    def __init__(self, folder: str, offset: int = 0, size: int = 100):
        self.folder, self.offset, self.size = folder, offset, size

    def rows(self) -> list[dict]:
        files = sorted(glob.glob(os.path.join(self.folder, "*.json*")))
        sign = tuple((f, os.path.getmtime(f), os.path.getsize(f)) for f in files)
        if self._read.get(self.folder, (None,))[0] != sign:
            self._read[self.folder] = sign, sorted((json.loads(x) for f in files for x in open(f, encoding="utf-8") if x.strip()), key=lambda r: r["id"])
        return self._read[self.folder][1]

    def fetch(self, offset: int, size: int) -> list[dict]:
        rows = self.rows()
        at = bisect.bisect_right(rows, offset, key=lambda r: r["id"])
        return rows[at : at + size]

    def list_new(self, state: dict) -> Iterator[dict]:
        self.offset = max(self.offset, int(state.get("offset", 0)))
        for row in pages(self.fetch, self.offset, self.size):
            self.offset = row["id"]
            yield row

    def get_state(self) -> dict:
        return {"offset": self.offset}


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"offset": 0}

    def _rows(self, connector: FolderConnector, state: dict) -> list[tuple]:
        return [tuple(r.get(f.name) if f.name != "data" or r.get("data") is None else r["data"].encode() for f in MESSAGES.fields) for r in connector.list_new(state)]

    def read(self, start: dict):
        """All messages after the offset, and the offset after them; so one run drains the source."""
        connector = FolderConnector(self.folder)
        rows = self._rows(connector, start)
        return iter(rows), connector.get_state()

    def readBetweenOffsets(self, start: dict, end: dict):
        rows = self._rows(FolderConnector(self.folder), start)
        at = MESSAGES.fieldNames().index("id")
        return iter([r for r in rows if r[at] <= end["offset"]])


class MessageFolder(DataSource):
    """spark.readStream.format("message_folder").option("path", folder)"""

    @classmethod
    def name(cls) -> str:
        return "message_folder"

    def schema(self):
        return MESSAGES

    def simpleStreamReader(self, schema):
        return _Reader(self.options["path"])


def stream(spark: SparkSession, folder: str, kind: str = "json", files: int | None = None) -> DataFrame:
    """Messages as a stream: Spark's own file source, which reads in parallel and commits files as offsets. files: the
    most of them in a batch."""
    reader = spark.readStream.schema(MESSAGES).format(kind)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(folder)


def stream_by_offset(spark: SparkSession, folder: str) -> DataFrame:
    """The same by ids as offsets, for one small source a stream."""
    spark.dataSource.register(MessageFolder)
    return spark.readStream.format("message_folder").option("path", folder).load()
