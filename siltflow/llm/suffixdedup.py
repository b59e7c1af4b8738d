"""Removal of repeated byte strings by column-wise construction of a multi-document suffix order.

A start is repeated if the `length` bytes from it also start anywhere else; every byte of a repeated string goes.

1. Every window of `length` bytes has a minimizer, its k-byte string of least hash (32 bits of it, the same ones in
   every text), leftmost of equals. Equal windows have equal minimizers at equal distances. Runs of starts with one minimizer form a piece: its text, aligned at the
   minimizer. Only hashes are shuffled, by minimizer; adjoining equal pieces, as in periodic texts, are one row.
2. A minimizer seen in one piece once has nothing repeated. A piece seen twice is repeated as a whole. Only where
   different pieces share a minimizer must texts be compared; one text of each different piece is fetched.
3. The pieces of a part of the minimizers are a collection of documents, aligned at the minimizer. Columns are
   inserted from the right, one symbol of each document a round. A round reads the segment of the collection's
   Burrows-Wheeler transform that the round before wrote, the symbols in front of all suffixes in their order: a stable
   sort by these symbols is the order of the suffixes one symbol longer, and the common prefix of neighbours is 1 plus
   the least of those between them before. It then writes the next segment, with order and common prefixes. Strings of
   different columns can't be equal (step 1), so segments needn't be merged. Columns and segments are files in the
   shared folder, read and written one after another; a task that is run again writes its own. Neighbours with
   `length` common symbols are repeated starts.
4. Repeated starts become byte spans of their documents, merged and cut out.

Minimizers shared by more than `hot` different pieces, or by more rows than a task holds, are not put into one
collection: the windows of their different pieces are counted by 128-bit hashes, which splits them over any number of
tasks; the result is the same.

Null texts are empty. Texts under `length` bytes lose nothing. Documents are told apart by id and 64 bits of a hash of
the text, those without an id by 128 bits. Rows equal in both have the same spans, so they need no names of their own:
each repeats all strings of its copies. An empty
table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import Scratch, settle, shared_dir, table
from .tokens import U, chunks, mix64, prefix, spans_hash

K = 16
PIECE = "mz bigint, ph bigint, id bigint, h bigint, pos int, n int, reps int, left int"


def kmer_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the K = 16 bytes from each place."""
    n = len(data) - K + 1
    at = lambda i: np.ndarray((n,), "<u8", data, i, (1,)).astype(np.uint64)
    return mix64(at(0) * U(0x9FB21C651E98DF25) + mix64(at(8)))


def cut_pieces(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, first start, number of starts, minimizer's place and its hash of each piece of the chunk."""
    w = length - K + 1
    n = len(data) - K + 1
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    if n < w:
        return none
    data = np.ascontiguousarray(data)
    full = kmer_hashes(data)
    value = (full >> U(32)) << U(32) | np.arange(n, dtype=np.uint64)  # the order of a string depends on its bytes alone, wherever it stands
    pad = -n % w
    blocks = np.r_[value, np.full(pad, ~U(0))].reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()[:n]
    behind = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()[:n]
    least = (np.minimum(behind[: n - w + 1], ahead[w - 1 :]) & U((1 << 32) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: n - w + 1]
    start = np.flatnonzero(np.arange(n - w + 1) + length <= offs[row + 1])
    if not len(start):
        return none
    least, row = least[start], row[start]
    new = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (row[1:] != row[:-1])])
    n_starts = np.diff(np.r_[new, len(start)])
    return row[new], start[new], n_starts, least[new], full[least[new]]


def pieces(docs: DataFrame, length: int) -> DataFrame:
    """docs: id, h, text. A row for each piece, left is its minimizer's place; adjoining equal pieces of a periodic text are one row with their number, reps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                ids, hs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for lo, _, data, offs in chunks(batch.column(2)):
                    row, start, n, least, mz = cut_pieces(data, offs, length)
                    ph = mix64(spans_hash(prefix(data), start, start + n + length - 1))
                    new = np.flatnonzero(np.r_[True, (mz[1:] != mz[:-1]) | (ph[1:] != ph[:-1]) | (n[1:] != n[:-1]) | (row[1:] != row[:-1])]) if len(row) else np.zeros(0, np.int64)
                    reps = np.diff(np.r_[new, len(row)])
                    row, start, n, least, mz, ph = row[new], start[new], n[new], least[new], mz[new], ph[new]
                    places = (start - offs[row], n, reps, least - start)
                    yield pa.RecordBatch.from_arrays([pa.array(mz.view(np.int64)), pa.array(ph.view(np.int64)), pa.array(ids[lo + row]), pa.array(hs[lo + row]), *(pa.array(x.astype(np.int32)) for x in places)], [x.split()[0] for x in PIECE.split(", ")])

    return docs.select("id", "h", "text").mapInArrow(run, PIECE)


def judge(t: pa.Table, hot: int, after: tuple[int, int] | None, before: int | None) -> pa.RecordBatch:
    """t: sorted pieces with all of their minimizers, unless after or before say otherwise: (minimizer, ph) of the row
    before t, whose minimizer is known to be hot; and the ph of the row after t, whose minimizer is t's only one, and hot."""
    mz, ph, reps = (t.column(c).to_numpy() for c in ("mz", "ph", "reps"))
    new_mz = np.r_[True, mz[1:] != mz[:-1]]
    new_ph = new_mz | np.r_[True, ph[1:] != ph[:-1]]
    if after is not None and after == (mz[0], ph[0]):
        new_ph[0] = False
    twice = ~new_ph
    twice[:-1] |= (mz[1:] == mz[:-1]) & (ph[1:] == ph[:-1])
    if before is not None:
        twice[-1] |= ph[-1] == before
    sure = twice | (reps > 1)
    at_mz = np.cumsum(new_mz) - 1
    different = np.bincount(at_mz, new_ph)[at_mz]
    split = different > hot
    if after is not None:
        split |= mz == after[0]
    if before is not None:
        split[:] = True
    keep = sure | split | (different > 1)
    columns = [t.column(c).combine_chunks().filter(pa.array(keep)) for c in t.schema.names]
    extra = [sure, new_ph & (split | (different > 1)), split]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array(x[keep]) for x in extra)], [*t.schema.names, "sure", "rep", "split"])


def judge_sorted(batches: Iterator[pa.RecordBatch], hot: int, most: int) -> Iterator[pa.RecordBatch]:
    """Judges pieces sorted by mz and ph. It holds about `most` rows; a minimizer with more is hot, and told row by row."""
    held: list[pa.RecordBatch] = []
    after: tuple[int, int] | None = None
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < most:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        mz, ph = t.column("mz").to_numpy(), t.column("ph").to_numpy()
        end = int(np.searchsorted(mz, mz[-1]))
        if end:
            yield judge(t.slice(0, end).combine_chunks(), hot, after, None)
            after = None
        elif len(mz) > 1:  # one minimizer fills the buffer: all but the last row, which shows what follows
            end = len(mz) - 1
            yield judge(t.slice(0, end).combine_chunks(), hot, after, int(ph[-1]))
            after = (int(mz[end - 1]), int(ph[end - 1]))
        held = t.slice(end).combine_chunks().to_batches()
    if held and (t := pa.Table.from_batches(held).combine_chunks()).num_rows:
        yield judge(t, hot, after, None)


def judged(found: DataFrame, hot: int) -> DataFrame:
    """Pieces that matter, with what is known of them: sure (repeated as a whole), rep (the first of equal pieces, whose
    text stands for them), split (its minimizer is hot)."""
    rows = found.repartition("mz").sortWithinPartitions("mz", "ph")
    return rows.mapInArrow(lambda batches: judge_sorted(batches, hot, 2 * hot), PIECE + ", sure boolean, rep boolean, split boolean")


class Files:
    """Files of one task in a folder of its own below a shared one, on any file system that pyarrow opens by URI."""

    def __init__(self, shared: str):
        self.fs, root = pafs.FileSystem.from_uri(shared)
        self.folder = f"{root}/columns-{uuid.uuid4().hex}"
        self.fs.create_dir(self.folder, recursive=True)

    def write(self, name: str, *arrays: np.ndarray) -> None:
        with self.fs.open_output_stream(f"{self.folder}/{name}") as f:
            for a in arrays:
                f.write(np.ascontiguousarray(a))

    def read(self, name: str) -> bytes:
        with self.fs.open_input_stream(f"{self.folder}/{name}") as f:
            return f.read()

    def part(self, name: str, at: int, n: int) -> bytes:
        with self.fs.open_input_file(f"{self.folder}/{name}") as f:
            return f.read_at(n, at)

    def drop(self, name: str) -> None:
        self.fs.delete_file(f"{self.folder}/{name}")

    def __enter__(self) -> Files:
        return self

    def __exit__(self, *_) -> None:
        self.fs.delete_dir(self.folder)


class Collection:
    """Pieces aligned at their minimizers; repeats() inserts their columns from the right."""

    def __init__(self, texts: list[np.ndarray], left: np.ndarray, length: int, files: Files):
        self.length, self.n, self.files = length, len(texts), files
        size = np.array([len(t) for t in texts])
        self.zero = int(left.max())
        self.lo, self.hi = self.zero - left, self.zero - left + size
        self.width = int(self.hi.max())
        columns = np.zeros((self.width, self.n), np.uint8)
        for at in range(0, self.n, 20_000):  # rows to columns, a block at a time
            block = np.zeros((len(texts[at : at + 20_000]), self.width), np.uint8)
            flat = np.concatenate(texts[at : at + 20_000])
            z = size[at : at + 20_000]
            inside = np.arange(len(flat)) - np.repeat(np.cumsum(z) - z, z)
            block[np.repeat(np.arange(len(z)), z), np.repeat(self.lo[at : at + 20_000], z) + inside] = flat
            columns[:, at : at + 20_000] = block.T
        files.write("columns", columns)

    def segment(self, c: int, order: np.ndarray, common: np.ndarray) -> None:
        """Writes the transform's segment before column c: of the suffixes that begin there, in their order, and of the
        documents that end there, whose suffix is empty, sorts first and shares nothing, the symbols in front of them;
        with the order and the common prefixes that belong to it. Documents that begin at c leave."""
        entered = self.join[self.joins[c + 1] if c + 1 <= self.width else 0 : self.joins[c]]
        if len(entered):
            order = np.r_[entered, order]
            common = np.r_[np.zeros(len(entered) + (len(common) > 0), np.uint8), common[1:]]
        column = np.frombuffer(self.files.part("columns", (c - 1) * self.n, self.n), np.uint8) if c else np.zeros(self.n, np.uint8)
        self.files.write(f"segment-{c}", np.int64([len(order)]), order, common, column[order])

    def read(self, c: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, name = self.files.read(f"segment-{c}"), f"segment-{c}"
        self.files.drop(name)
        n = int(np.frombuffer(data, np.int64, 1)[0])
        return np.frombuffer(data, np.int32, n, 8), np.frombuffer(data, np.uint8, n, 8 + 4 * n), np.frombuffer(data, np.uint8, n, 8 + 5 * n)

    def repeats(self) -> np.ndarray:
        """rows x starts: whether the string of `length` from a piece's start is in two pieces or more."""
        out = np.zeros((self.n, int((self.hi - self.lo).max()) - self.length + 1), bool)
        self.join = np.argsort(-self.hi, kind="stable").astype(np.int32)
        self.joins = np.searchsorted(-self.hi[self.join], -np.arange(self.width + 1), "right")
        self.segment(self.width, np.zeros(0, np.int32), np.zeros(0, np.uint8))
        for c in range(self.width - 1, -1, -1):
            order, common, symbol = self.read(c + 1)
            active = np.flatnonzero(self.lo[order] <= c)
            at = active[np.argsort(symbol[active], kind="stable")]
            if len(at):
                least = np.minimum.reduceat(np.r_[common, np.uint8(255)], at + 1)
                symbol = symbol[at]
                same = symbol[1:] == symbol[:-1]
                order = order[at]
                common = np.r_[np.uint8(0), np.where(same, np.minimum(least[:-1], 254) + 1, 0).astype(np.uint8)]
                twin = np.flatnonzero(common >= self.length)
                if len(twin):
                    docs = np.r_[order[twin], order[twin - 1]]
                    out[docs, c - self.lo[docs]] = True
            else:
                order, common = order[:0], common[:0]
            self.segment(c, order, common)
        return out


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and end of each run of True in the rows of mask."""
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1]


SPAN = "id bigint, h bigint, s int, e int"


def collection_spans(texts: DataFrame, length: int, most: int = 48 << 20) -> DataFrame:
    """texts: mz, id, h, pos, left, sure, piece. Spans of repeated strings in pieces that occur once."""
    shared = shared_dir(texts.sparkSession)

    def solve(t: pa.Table) -> pa.RecordBatch:
        piece = t.column("piece").combine_chunks().cast(pa.large_binary())
        offs = np.frombuffer(piece.buffers()[1], np.int64)[piece.offset : piece.offset + len(piece) + 1]
        data = np.frombuffer(piece.buffers()[2], np.uint8)
        with Files(shared) as files:
            mask = Collection([data[a:b] for a, b in zip(offs, offs[1:])], t.column("left").to_numpy(), length, files).repeats()
        mask[t.column("sure").to_numpy(zero_copy_only=False)] = False
        row, first, end = runs(mask)
        pos = t.column("pos").to_numpy()[row]
        return pa.RecordBatch.from_arrays([pa.array(t.column("id").to_numpy()[row]), pa.array(t.column("h").to_numpy()[row]), pa.array((pos + first).astype(np.int32)), pa.array((pos + end - 1 + length).astype(np.int32))], ["id", "h", "s", "e"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) >= most:
                t = pa.Table.from_batches(held).combine_chunks()
                mz = t.column("mz").to_numpy()
                end = int(np.searchsorted(mz, mz[-1]))
                held = t.slice(end).combine_chunks().to_batches()
                if end:
                    yield solve(t.slice(0, end).combine_chunks())
        if held and (t := pa.Table.from_batches(held).combine_chunks()).num_rows:
            yield solve(t)

    return texts.repartition("mz").sortWithinPartitions("mz").mapInArrow(run, SPAN)


def fetch(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The texts of wanted pieces (mz, id, h, pos, n, left, sure): mz, id, h, pos, left (of the minimizer), sure, piece."""
    lists = wanted.groupBy("id", "h").agg(F.collect_set(F.struct("pos", "n", "mz", "left", "sure")).alias("p"))
    joined = docs.join(lists, ["id", "h"]).select("id", "h", "text", "p.pos", "p.n", "p.mz", "p.left", "p.sure")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for i, h, text, *lists in zip(*(c.to_pylist() if k != 2 else c for k, c in enumerate(batch.columns))):
                data = text.as_py().encode()
                for p, z, m, left, s in zip(*lists):
                    for column, v in zip(rows, (m, i, h, p, left, s, data[p : p + z + length - 1])):
                        column.append(v)
                    if len(rows[0]) >= 20_000:
                        yield _piece_batch(rows)
                        rows = [[] for _ in range(7)]
            yield _piece_batch(rows)

    return joined.mapInArrow(run, "mz bigint, id bigint, h bigint, pos int, left int, sure boolean, piece binary")


def _piece_batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], ["mz", "id", "h", "pos", "left", "sure", "piece"])


def hot_spans(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Spans of repeated windows of hot minimizers: every window's 128-bit hash is counted, with partial counts before the shuffle."""
    lists = wanted.groupBy("id", "h").agg(F.collect_set(F.struct("pos", "n")).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for i, h, text, pos, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                    data = np.frombuffer(text.as_py().encode(), np.uint8)
                    s = np.concatenate([np.arange(p, p + z) for p, z in zip(pos, n)])
                    one, two = prefix(data), prefix(data[::-1])
                    a = mix64(spans_hash(one, s, s + length))
                    b = mix64(spans_hash(two, len(data) - s - length, len(data) - s))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i, np.int64)), pa.array(np.full(len(s), h, np.int64)), pa.array(s.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["id", "h", "s", "a", "b"])

    windows = settle(docs.join(lists, ["id", "h"]).select("id", "h", "text", "p.pos", "p.n").mapInArrow(run, "id bigint, h bigint, s int, a bigint, b bigint"))
    twice = windows.groupBy("a", "b").agg(F.count("*").alias("c")).where("c > 1").select("a", "b")
    return windows.join(twice, ["a", "b"]).select("id", "h", "s", (F.col("s") + length).alias("e"))


RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def remove(joined: DataFrame) -> DataFrame:
    """joined: doc_id, text, s, e (arrays of spans or null). Cuts the merged spans out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, s, e in zip(batch.column(1), batch.column(2), batch.column(3)):
                data = (text.as_py() or "").encode()
                removed = spans = 0
                if s.as_py():
                    first, end = np.array(s.as_py()), np.array(e.as_py())
                    o = np.argsort(first, kind="stable")
                    first, end = first[o], np.maximum.accumulate(end[o])
                    new = np.flatnonzero(np.r_[True, first[1:] > end[:-1]])
                    first, end = first[new], end[np.r_[new[1:] - 1, len(end) - 1]]
                    removed, spans = int((end - first).sum()), len(first)
                    kept = b"".join(data[a:b] for a, b in zip([0, *end.tolist()], [*first.tolist(), len(data)]))
                else:
                    kept = data
                rows.append((len(data), removed, spans, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.select("doc_id", "text", "s", "e").mapInArrow(run, RESULT)


def repeated_spans(docs: DataFrame, length: int = 200, hot: int = 100_000) -> DataFrame:
    """docs: id, h, text. Spans (id, h, s, e) of bytes whose union is all bytes of repeated strings."""
    found = Scratch(docs.sparkSession).keep(judged(pieces(docs, length), hot), "found")
    whole = found.where("sure").select("id", "h", F.col("pos").alias("s"), (F.col("pos") + F.col("n") * F.col("reps") - 1 + length).cast("int").alias("e"))
    texts = fetch(docs, found.where("rep and not split").select("mz", "id", "h", "pos", "n", "left", "sure"), length)
    out = whole.union(collection_spans(texts, length))
    if found.where("split").head(1):
        out = out.union(hot_spans(docs, found.where("split and rep").select("id", "h", "pos", "n"), length))
    return out


def deduplicate(docs: DataFrame, length: int = 200, hot: int = 100_000) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    other = F.xxhash64(F.lit(7), "text")  # names rows without an id, beside h
    own = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), other).alias("id"), F.xxhash64("text").alias("h"), "text")
    spans = repeated_spans(own.where("octet_length(text) >= %d" % length), length, hot)
    lists = spans.groupBy("id", "h").agg(F.collect_set(F.struct("s", "e")).alias("p")).select(F.col("id").alias("p_id"), F.col("h").alias("p_h"), "p.s", "p.e")
    joined = own.join(lists, (F.col("id") == F.col("p_id")) & (F.col("h") == F.col("p_h")), "left")
    return remove(joined.withColumn("doc_id", F.col("doc_id").cast("bigint")))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Strings of 200 bytes, as 400 hexadecimal digits, are counted by two hashes; spans of those that occur twice are merged.
OP1_SQL = r"""
WITH l AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, len(x) // 2 AS n FROM documents),
w AS (SELECT r, i, hash(substr(x, 2 * i - 1, 400)) AS h1, hash('x' || substr(x, 2 * i - 1, 400)) AS h2
  FROM (SELECT r, x, unnest(range(1, n - 198)) AS i FROM l WHERE n >= 200)),
t AS (SELECT r, i FROM w QUALIFY count(*) OVER (PARTITION BY h1, h2) > 1),
g AS (SELECT r, i, i + 200 AS e, lag(i + 200) OVER (PARTITION BY r ORDER BY i) AS before FROM t),
s AS (SELECT r, i, e, sum(CASE WHEN before >= i THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS k FROM g),
m AS (SELECT r, k, min(i) AS s, max(e) AS e FROM s GROUP BY ALL),
a AS (SELECT r, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es FROM m GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN ss IS NULL THEN x ELSE array_to_string(list_transform(range(1, len(ss) + 2), lambda j:
    substr(x, 2 * CASE WHEN j = 1 THEN 1 ELSE es[j - 1] END - 1, 2 * (CASE WHEN j > len(ss) THEN n + 1 ELSE ss[j] END - CASE WHEN j = 1 THEN 1 ELSE es[j - 1] END))), '') END)) AS kept_sha256
FROM l LEFT JOIN a USING (r)
"""
