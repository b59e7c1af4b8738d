"""Language identification with language-bitmask n-gram filters.

Training counts the n-grams (4 bytes of lower-cased, letter-only text) of each language over all training rows; the
most frequent ones that make up `coverage` of the language's n-grams are its own, whatever the table's size. They go
into a bit-sliced Bloom filter: a slot holds one bit for each language, so `hashes` look-ups and one AND return the
set of all languages that contain an n-gram. Slots are put together on the cluster; there are at most MOST_SLOTS, and
a fuller slice has more false positives, for which counts are corrected. A language's popcount over a text's n-grams
is corrected for the rate of false positives that the fill of its slice implies; the largest corrected count decides,
and its share of the text's n-grams is the score.

Null texts, and texts with no letter, are 'und' with score 0; so is everything if no training row has a language.
Ties, also of texts without a known n-gram, go to the language first in code point order. Repeated rows are scored and counted each. Texts of any length
are read whole. An empty table gives no rows. Columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from .shared import fold, settle, table
from .tokens import U, chunks, mix64

#: Languages of one filter; more than that is an error, not a cap on what is learned.
MOST_LANGUAGES = 1024
MOST_SLOTS = 1 << 22
N = 4


class _Fold(dict):
    """A str.translate table: letters stay, all else becomes a space; filled as characters are met."""

    def __missing__(self, c: int) -> int:
        self[c] = out = c if chr(c).isalpha() else 32
        return out


FOLD = _Fold()


def folded(texts: pa.Array) -> pa.Array:
    """Lower-cased texts with every run of characters other than letters as one space, two at both ends; no letter: empty."""
    cores = (" ".join(t.lower().translate(FOLD).split()) if t else "" for t in texts.to_pylist())
    return pa.array([f"  {x}  " if x else "" for x in cores], pa.large_string())


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a chunk of folded texts and the row of each."""
    if len(data) < N:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    d = data.astype(np.uint32)
    g = d[: -N + 1] << 24 | d[1 : -N + 2] << 16 | d[2 : -N + 3] << 8 | d[3:]
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    inside = row[: -N + 1] == row[N - 1 :]
    return g[inside], row[: -N + 1][inside]


def batch_grams(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """First row, n-grams, the row of each from there, and rows, over runs of whole texts of a bounded size."""
    for lo, hi, _, _ in chunks(texts):
        data = folded(texts.slice(lo, hi - lo))
        for _, _, data, offs in chunks(data, 1 << 62):
            yield lo, *grams(data, offs), hi - lo


def gram_counts(docs: DataFrame) -> DataFrame:
    """docs: lang, text. Returns lang, gram, n; sums are partial within each batch and task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = sorted(set(batch.column(0).to_pylist()))
            of = np.array([names.index(x) for x in batch.column(0).to_pylist()], np.uint64)
            parts = []
            for lo, g, row, _ in batch_grams(batch.column(1)):
                parts.append(np.unique(of[lo + row] << U(32) | g.astype(np.uint64), return_counts=True))
            if not parts:
                continue
            key = np.concatenate([k for k, _ in parts])
            keys, inverse = np.unique(key, return_inverse=True)
            n = np.bincount(inverse, np.concatenate([c for _, c in parts])).astype(np.int64)
            lang = pa.DictionaryArray.from_arrays(pa.array((keys >> U(32)).astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([lang, pa.array((keys & U(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Filter:
    """Languages, slots x words of bits, and the rate of false positives of each language's slice."""

    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray
    hashes: int

    @staticmethod
    def places(gram: np.ndarray, hashes: int, m: int) -> list[np.ndarray]:
        h = mix64(gram.astype(np.uint64))
        step = (h >> U(32)) | U(1)
        return [((h + U(i) * step) & U(m - 1)).astype(np.int64) for i in range(hashes)]

    @classmethod
    def build(cls, lang: np.ndarray, gram: np.ndarray, hashes: int = 4) -> Filter:
        """From arrays, one language and n-gram each."""
        languages = sorted(set(lang))
        code = np.searchsorted(languages, lang)
        slots = np.zeros((cls.size(int(np.bincount(code).max()) if len(code) else 1, hashes), max(1, -(-len(languages) // 64))), np.uint64)
        for at in cls.places(gram, hashes, len(slots)):
            np.bitwise_or.at(slots, (at, code // 64), U(1) << (code % 64).astype(np.uint64))
        return cls.of(languages, slots, hashes)

    @staticmethod
    def size(largest: int, hashes: int) -> int:
        return min(MOST_SLOTS, 1 << max(12, (largest * hashes * 2 - 1).bit_length()))

    @classmethod
    def of(cls, languages: list[str], slots: np.ndarray, hashes: int) -> Filter:
        fill = np.array([(slots[:, i // 64] >> U(i % 64) & U(1)).mean() for i in range(len(languages))])
        return cls(languages, slots, fill**hashes, hashes)

    def members(self, gram: np.ndarray) -> np.ndarray:
        """The language bits of each n-gram."""
        first, *rest = self.places(gram, self.hashes, len(self.slots))
        out = self.slots[first]
        for at in rest:
            out &= self.slots[at]
        return out

    def decide(self, gram: np.ndarray, row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
        """The best language's index and the score of each row; -1 and 0 for rows without n-grams."""
        n = np.bincount(row, minlength=n_rows)
        if not len(self.languages):
            return np.full(n_rows, -1), np.zeros(n_rows)
        bits = self.members(gram)
        some = np.flatnonzero(n)
        starts = (np.cumsum(n) - n)[some]
        best, score = np.full(n_rows, -1), np.full(n_rows, -np.inf)
        for i, f in enumerate(self.false_rate):
            count = np.zeros(n_rows)
            if len(some):
                count[some] = np.add.reduceat((bits[:, i // 64] >> U(i % 64) & U(1)).astype(np.uint8), starts, dtype=np.int64)
            true = np.maximum((count - n * f) / (1 - f), 0) if f < 1 else np.zeros(n_rows)
            better = true > score + 1e-9
            best[better], score[better] = i, true[better]
        return np.where(n > 0, best, -1), np.where(n > 0, np.clip(score / np.maximum(n, 1), 0, 1), 0)


def train(docs: DataFrame, coverage: float = 0.99, hashes: int = 4) -> Filter:
    """docs: lang, text; rows with null lang or text are no training rows. What is collected is the filter's slots."""
    counts = settle(gram_counts(docs.where("lang is not null and text is not null")))
    # the least count of the n-grams that are kept, from the distribution of counts: a few rows for each language
    by = counts.groupBy("lang", "n").agg(F.sum("n").alias("mass"))
    of = W.partitionBy("lang")
    above = F.sum("mass").over(of.orderBy(F.desc("n"))) - F.col("mass")
    least = by.select("lang", "n", above.alias("above"), F.sum("mass").over(of).alias("total")).where(F.col("above") < coverage * F.col("total")).groupBy("lang").agg(F.min("n").alias("least"))
    kept = counts.join(least, "lang").where("n >= least")
    sizes = {r["lang"]: r["count"] for r in kept.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages, the most that a filter has")
    languages = sorted(sizes)
    m = Filter.size(max(sizes.values(), default=1), hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.searchsorted(languages, np.array(batch.column(0).to_pylist(), object)) if len(batch) else np.zeros(0, np.int64)
            at = np.concatenate(Filter.places(batch.column(1).to_numpy(), hashes, m))
            code = np.tile(code, hashes)
            bit = np.left_shift(U(1), (code % 64).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(code // 64), pa.array(bit)], ["slot", "word", "bit"])

    found = kept.select("lang", "gram").mapInArrow(run, "slot bigint, word bigint, bit bigint").groupBy("slot", "word").agg(F.bit_or("bit").alias("bits")).toArrow()
    slots = np.zeros((m, max(1, -(-len(languages) // 64))), np.uint64)
    slots[found.column("slot").to_numpy(), found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Filter.of(languages, slots, hashes)


def annotate(docs: DataFrame, model: Filter, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns of docs that keep names, or all, then lang_pred and score; docs has none of these two names."""
    names_kept = list(keep or docs.columns)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in batches:
            for lo, g, row, n in batch_grams(batch.column("text")):
                best, score = m.decide(g, row, n)
                names = pa.array([m.languages[i] if i >= 0 else "und" for i in best.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, n) for c in names_kept), names, pa.array(score)], [*names_kept, "lang_pred", "score"])

    schema = T.StructType([*(docs.schema[c] for c in names_kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, model: Filter) -> DataFrame:
    """doc_id, lang_pred, score for each row."""
    return annotate(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), model, keep=("doc_id",))


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Learns from rows outside fold 0; returns doc_id, held_out, lang_pred, score for all rows."""
    model = train(docs.where(fold("doc_id", folds) != 0).select("lang", "text"))
    out = predict(docs, model)
    return out.select("doc_id", (fold("doc_id", folds) == 0).alias("held_out"), "lang_pred", "score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
