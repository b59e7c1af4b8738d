"""Quality rules: an isolation forest on rule statistics.

Rule statistics of each whole text (word and symbol counts, repeated lines and windows, upper-case letters, end
marks, distinct words) are counted in numpy. An isolation forest over all of them, as rates, gives each document the
mean path length over random splits; short paths are anomalous. The cut-off of the score is calibrated
on labelled rows: of the cut-offs that lose at most `most_lost` of the rows labelled good, that which tells best.

The forest's trees are each grown on `per_tree` rows, drawn by hash from all different (id, statistics), as the method
has it: a sample of about trees * per_tree rows is collected, however many documents there are and however often a row
is repeated, in an order of its own, so that any partitioning gives the same forest. Every document is scored. Counts, folds and
the calibration cover all rows.

Null text: no words, so it fails the base rules. Without labels of both kinds the cut-off is 1: the forest rejects
nothing. Null features can't occur; equal rows get equal scores. Repeated rows are scored each. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import fold, settle, table
from .tokens import U, Words, chunks, mix64, powers, prefix, spans_hash

WINDOW = 8
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
UPPER = np.isin(np.arange(256), np.arange(65, 91))
MARK = np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8))
LEADS = (np.arange(256) & 0xC0) != 0x80
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_mark", "n_distinct", "n_lines"]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    order = np.argsort(keys)
    k = keys[order]
    same = k[1:] == k[:-1]
    out = np.zeros(len(keys), bool)
    out[order] = np.r_[same, False] | np.r_[False, same] if len(keys) else False
    return out


def later(keys: np.ndarray) -> np.ndarray:
    """Whether each key has an equal one before it."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    out = np.zeros(len(keys), bool)
    out[order[1:]] = k[1:] == k[:-1]
    return out


def count(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    w = Words(data, offs)
    n_rows = w.n_rows
    rows = np.repeat(np.arange(n_rows), np.diff(offs))
    per = lambda mask: np.bincount(rows[mask], minlength=n_rows)
    out = {"n_words": w.per_row, "n_symbols": per(SYMBOLS[data]), "n_upper": per(UPPER[data]), "n_mark": per(MARK[data])}
    leads = np.r_[0, np.cumsum(LEADS[data])]
    out["word_chars"] = np.bincount(w.row, leads[w.end] - leads[w.start], n_rows).astype(np.int64)
    sums = prefix(data)
    tag = lambda row: mix64(row.astype(np.uint64) + U(1))
    h = mix64(spans_hash(sums, w.start, w.end))
    out["n_distinct"] = w.per_row - np.bincount(w.row[later(mix64(h ^ tag(w.row)))], minlength=n_rows)
    # lines: from each text's start or a \n to the next \n or the text's end
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.r_[offs[:-1][np.diff(offs) > 0], breaks + 1])
    row = np.searchsorted(offs, start, "right") - 1
    inside = start < offs[np.minimum(row + 1, n_rows)]
    start, row = start[inside], row[inside]
    keep = np.r_[start[1:] != start[:-1], True] if len(start) else np.zeros(0, bool)
    start, row = start[keep], row[keep]
    after = np.searchsorted(breaks, start)
    end = np.minimum(np.r_[breaks, len(data)][after], offs[row + 1])
    worded = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, row = start[worded], end[worded], row[worded]
    out["n_lines"] = np.bincount(row, minlength=n_rows)
    out["n_dup_lines"] = np.bincount(row[later(mix64(mix64(spans_hash(sums, start, end)) ^ tag(row)))], minlength=n_rows)
    # windows: hashes over the words' hashes, tagged with the row
    n = len(h)
    covered = np.zeros(n + 1, np.int64)
    if n >= WINDOW:
        size = 1 << (n + 1).bit_length()
        total = np.r_[U(0), np.cumsum(h * powers(0xD1342543DE82EF95, size)[:n])]
        i = np.flatnonzero(w.row[: n - WINDOW + 1] == w.row[WINDOW - 1 :])
        key = (total[i + WINDOW] - total[i]) * powers(pow(0xD1342543DE82EF95, -1, 1 << 64), size)[i]
        twice = i[repeated(mix64(mix64(key) ^ tag(w.row[i])))]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(w.row[np.cumsum(covered[:-1]) > 0], minlength=n_rows)
    return out


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS for each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                parts = [count(data, offs) for _, _, data, offs in chunks(batch.column(1))]
                columns = [np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for c in COUNTS]
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["doc_id", *COUNTS])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS))


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """The rule statistics as rates, which the forest splits on: symbols, end marks, characters and repeated windows for
    each word, repeated lines for each line, the share of upper case, and of words seen before."""
    words, chars, lines = (np.maximum(c[n], 1) for n in ("n_words", "word_chars", "n_lines"))
    return np.stack([c["n_symbols"] / words, c["n_mark"] / words, c["word_chars"] / words, c["n_repeat_words"] / words, c["n_dup_lines"] / lines, c["n_upper"] / chars, 1 - c["n_distinct"] / words], 1)


class Forest:
    """Isolation trees as arrays of one width: feature (-1: leaf), cut, children and path length at the leaf."""

    def __init__(self, x: np.ndarray, trees: int, per_tree: int, seed: int):
        rng = np.random.default_rng(seed)
        self.norm = self.expected(min(per_tree, max(2, len(x))))
        self.depth = max(1, int(np.ceil(np.log2(max(2, per_tree)))))
        self.trees = [self.grow(x[rng.permutation(len(x))[:per_tree]], rng) for _ in range(trees)] if len(x) else []

    @staticmethod
    def expected(n: float) -> float:
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def grow(self, x: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        feature, cut, left, path = [], [], [], []

        def add() -> int:
            for column, v in ((feature, -1), (cut, 0.0), (left, 0), (path, 0.0)):
                column.append(v)
            return len(feature) - 1

        todo = [(add(), x, 0)]
        while todo:
            at, rows, depth = todo.pop()
            lo, hi = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
            wide = np.flatnonzero(hi > lo)
            if depth >= self.depth or len(rows) < 2 or not len(wide):
                path[at] = depth + self.expected(len(rows))
                continue
            f = int(rng.choice(wide))
            feature[at], cut[at] = f, float(rng.uniform(lo[f], hi[f]))
            left[at], right = add(), add()
            below = rows[:, f] < cut[at]
            todo += [(left[at], rows[below], depth + 1), (right, rows[~below], depth + 1)]
        return np.array(feature), np.array(cut), np.array(left), np.array(path)

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 is anomalous."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, left, path in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, left[at] + (x[rows, np.maximum(f, 0)] >= cut[at]))
            total += path[at]
        return 2.0 ** (-total / max(1, len(self.trees)) / max(self.norm, 1e-9))


def judge(docs: DataFrame, labels: DataFrame, trees: int = 100, per_tree: int = 256, most_lost: float = 0.03, seed: int = 5) -> DataFrame:
    """docs: doc_id, text; labels: doc_id, quality (1 good, 0 bad). One row for each row of docs: doc_id, n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score. Calibrates on folds 1 to 4."""
    stats = settle(statistics(docs))
    different = settle(stats.distinct())
    share = min(1.0, trees * per_tree / max(1, different.count()))
    at = F.pmod(F.xxhash64("doc_id", *COUNTS, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))
    drawn = different.where(at).toArrow()
    drawn = drawn.sort_by([(c, "ascending") for c in drawn.column_names])
    forest = Forest(features({c: drawn.column(c).to_numpy() for c in COUNTS}), trees, per_tree, seed)
    shipped = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = shipped.value.score(features({c: b.column(c).to_numpy() for c in COUNTS}))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], [*b.schema.names, "score"])

    scored = settle(stats.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", score double"))
    scored = scored.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("l_id")).agg(F.min("quality").alias("quality"))
    seen = scored.where(~F.col("base_failed") & (fold("doc_id") != 0)).join(known, F.col("doc_id") == F.col("l_id"))
    bins = seen.groupBy(F.floor(F.col("score") * 2000).alias("bin")).agg(F.sum(F.col("quality")).alias("good"), F.count("*").alias("n")).orderBy("bin").collect()
    cut = cutoff([(r["bin"], r["good"], r["n"] - r["good"]) for r in bins], most_lost)
    kept = ~F.col("base_failed") & (F.floor(F.col("score") * 2000) < cut)
    return scored.select("doc_id", *COUNTS[:5], "base_failed", kept.alias("kept"), "score")


def cutoff(bins: list[tuple[int, int, int]], most_lost: float) -> int:
    """bins: (score bin, good rows, bad rows), ascending. Of the bins from which rejecting loses at most most_lost of the
    good, that with the largest share of bad rows rejected less good rows lost; the highest of equals."""
    good, bad = sum(b[1] for b in bins), sum(b[2] for b in bins)
    lost = caught = 0
    best, cut = 0.0, 2001
    for at, g, n in reversed(bins if good and bad else []):
        lost, caught = lost + g, caught + n
        if lost > most_lost * good:
            break
        if (gain := caught / bad - lost / good) > best:
            best, cut = gain, at
    return cut


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
