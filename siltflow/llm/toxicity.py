"""Toxicity: a weighted lexicon matched by Aho-Corasick.

Texts are folded first: lower case, homoglyphs of Latin letters, and digits or signs that stand for letters inside
words ('1d1ot'). The lexicon is learned from all labelled training rows: whole words, and stems that begin words,
whose documents are toxic far more often than others; a term's weight is its smoothed log odds. One automaton finds
all terms at once; of terms that overlap, the heaviest counts, and occurrences within an exception phrase don't. Exceptions
are learned too: word pairs around a term that toxic documents have no oftener than others. The weights found, in total and normalised by the text's length, give the score by a logistic curve fitted on a
histogram of the training rows.

The lexicon and the curve are fitted on about `most_labels` labelled rows at most, drawn by a hash of the id; what is
sent to the texts is so bounded. Terms, at most MOST_TERMS after stems that say no more than a shorter one are left
out, are never cut off: more of them are an error.

Null and empty texts find nothing and get the curve's value there; without toxic and other training rows every
score is the share of toxic rows (0 without any). A document labelled more than once counts as toxic if one label
is 1; null labels and others than 0 and 1 are ignored. Repeated rows are scored each. Whole texts are matched. An empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import Scratch, fold, settle, table

#: Letters of other scripts that look like Latin ones, and full-width letters.
HOMOGLYPHS = dict(zip("асеоріјѕухԁһкмтнвгαεικνορτυχѵɡıǀ", "aceopijsyxdhkmthbraeiknoptuxvgil")) | {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
#: Digits and signs that stand for letters inside words.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
MOST_TERMS = 500_000
#: Phrases in which a term of the lexicon is known to be harmless, besides those learned.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum")
_SIGHT, _LEET = str.maketrans(HOMOGLYPHS), str.maketrans(DIGITS)
_ANY, _TOKEN, _WORD = re.compile(r"[0-9@$]"), re.compile(r"[\w@$]+"), re.compile(r"[^\W\d_]+")
STEMS = range(5, 9)


def _letters(token: re.Match) -> str:
    """Signs that end a token stay; a token without letters, so a number, stays as it is."""
    whole = token[0]
    inner = whole.rstrip("@$")
    return inner.translate(_LEET) + whole[len(inner) :] if _ANY.search(inner) and _WORD.search(inner) else whole


def fold_text(text: str | None) -> str:
    t = (text or "").lower().translate(_SIGHT)
    if _ANY.search(t):
        t = _TOKEN.sub(_letters, t)
    return t


def terms_of(folded: str) -> set[str]:
    """Candidates: ' word ' for whole words, ' stem' for beginnings of words."""
    words = set(_WORD.findall(folded))
    out = {f" {w} " for w in words if len(w) >= 3}
    for k in STEMS:
        out |= {" " + w[:k] for w in words if len(w) > k}
    return out


def term_counts(rows: DataFrame, of: Callable[[str], set[str]] = terms_of) -> DataFrame:
    """rows: text, toxic. Returns term, toxic, other: the numbers of documents that have each of a folded text's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for i, (text, toxic) in enumerate(zip(batch.column(0), batch.column(1).to_pylist())):
                seen[toxic].update(of(fold_text(text.as_py())))
                if i + 1 == len(batch) or len(seen[0]) + len(seen[1]) > 500_000:
                    names = list(set(seen[0]) | set(seen[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][x] for x in names], pa.int64()), pa.array([seen[0][x] for x in names], pa.int64())], ["term", "toxic", "other"])
                    seen = (Counter(), Counter())

    return rows.select("text", "toxic").mapInArrow(run, "term string, toxic bigint, other bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)
    machine: object = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"machine": None}

    def prepare(self) -> bool:
        """Builds the automaton once; whether it has any term."""
        if self.machine is None:
            self.machine = ahocorasick.Automaton()
            for term, w in self.weights.items():
                self.machine.add_word(term, (len(term), w))
            for phrase in self.exceptions:
                self.machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
            self.machine.make_automaton()
        return len(self.machine) > 0

    def pairs(self, folded: str) -> set[str]:
        """'word word' for each term of the text, with the word before it and the one after."""
        words = _WORD.findall(folded)
        if not words or not self.prepare():
            return set()
        starts = {at: i for i, at in enumerate(accumulate((len(w) + 1 for w in words), initial=0))}
        hits = {starts[end - n + 1] for end, (n, w) in self.machine.iter(" " + " ".join(words) + " ") if w is not None}
        return {f"{words[i]} {words[i + 1]}" for k in hits for i in (k - 1, k) if 0 <= i < len(words) - 1}

    def found(self, text: str | None) -> tuple[float, int]:
        """The weights found, and the number of words."""
        self.prepare()
        words = _WORD.findall(fold_text(text))
        if not words or not len(self.machine):
            return 0.0, len(words)
        hits, spared = [], []
        for end, (n, w) in self.machine.iter(" " + " ".join(words) + " "):
            (spared if w is None else hits).append((end - n + 1, end, w))
        hits = [h for h in hits if not any(s <= h[0] and h[1] <= e for s, e, _ in spared)]
        heaviest: dict[int, float] = {}
        for start, _, w in hits:  # terms overlap only where they begin the same word
            heaviest[start] = max(w, heaviest.get(start, w))
        return sum(heaviest.values()), len(words)

    def features(self, text: str | None) -> tuple[float, float]:
        total, n = self.found(text)
        return min(total, 40.0), min(100.0 * total / (n + 50), 40.0)

    def score(self, text: str | None) -> float:
        a, b, c = self.curve
        x, y = self.features(text)
        z = a + b * x + c * y
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def _odds(n_toxic: int, n_other: int):
    return F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("other") + 0.5) / (n_other + 1))


def bounded(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms; raise `least`")
    return rows


def learn_terms(counts: DataFrame, n_toxic: int, n_other: int, least: int) -> dict[str, float]:
    """All terms whose log odds are high and sure, but those that say no more than a shorter one that begins them."""
    odds = _odds(n_toxic, n_other)
    z = odds / F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + 0.5))
    good = settle(counts.where(F.col("toxic") >= least).select("term", odds.alias("odds"), z.alias("z")).where("odds > 1.5 and z > 3.5").select("term", "odds"))
    begins = [F.when(F.length(F.rtrim("term")) > k + 1, F.substring("term", 1, k + 1)) for k in STEMS]  # a stem has a blank in front
    shorter = good.select(F.col("term").alias("begin"), F.col("odds").alias("told"))
    vain = good.select("term", "odds", F.explode(F.array_compact(F.array(*begins))).alias("b")).join(shorter, F.col("b") == F.col("begin")).where("told >= odds - 0.7").select("term")
    return {r["term"]: r["odds"] for r in bounded(good.join(vain.distinct(), "term", "left_anti"), MOST_TERMS)}


def learn_exceptions(rows: DataFrame, lex: Lexicon, n_toxic: int, n_other: int, least: int) -> tuple[str, ...]:
    """Word pairs with a term that aren't likelier in toxic documents."""
    pairs = rows.sparkSession.sparkContext.broadcast(lex)
    found = term_counts(rows, lambda t: pairs.value.pairs(t)).where((F.col("other") >= least) & (_odds(n_toxic, n_other) <= 0))
    return tuple(sorted(r["term"] for r in bounded(found.select("term"), MOST_TERMS)))


def fit_curve(bins: list[tuple[float, float, int, int]]) -> tuple[float, ...]:
    """Logistic regression with a small ridge on (x, y, toxic, other) by Newton steps."""
    if not bins:
        return (-50.0, 0.0, 0.0)
    d = np.array(bins, float)
    x, t, n = np.c_[np.ones(len(d)), d[:, :2]], d[:, 2], d[:, 2] + d[:, 3]
    beta, ridge = np.zeros(3), np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (t - n * p) - ridge @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def lexicon(rows: DataFrame, least: int = 5, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """rows: text, toxic (0 or 1). Two passes over all rows, without the curve; what reaches the driver is bounded by MOST_TERMS."""
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    lex = Lexicon(learn_terms(term_counts(rows), n1, n0, least) if n1 and n0 else {}, exceptions)
    if lex.weights:
        lex = Lexicon(lex.weights, tuple(dict.fromkeys((*exceptions, *learn_exceptions(rows, lex, n1, n0, least)))))
    return lex


def measure(rows: DataFrame, lex: Lexicon) -> DataFrame:
    """rows: key, text. Returns key, x, y: the weights that each text holds, in total and normalised by its length."""
    shipped = rows.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.array([shipped.value.features(t.as_py()) for t in batch.column(1)], float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at[:, 0]), pa.array(at[:, 1])], ["key", "x", "y"])

    return rows.select(F.col("key").cast("bigint"), "text").mapInArrow(run, "key bigint, x double, y double")


def curve_of(rows: DataFrame) -> tuple[float, ...]:
    """rows: x, y, toxic. The curve of a histogram of 81 x 81 bins at most."""
    bins = rows.groupBy(*(F.rint(F.col(c) * 2).alias(c) for c in "xy")).agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o"))
    return fit_curve(sorted((r["x"] / 2, r["y"] / 2, r["t"], r["o"]) for r in bins.collect()))


def learn(rows: DataFrame, least: int = 5, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """rows: text, toxic (0 or 1). A lexicon and its curve, in three passes over all rows."""
    lex = lexicon(rows, least, exceptions)
    lex.curve = curve_of(measure(rows.select(F.col("toxic").alias("key"), "text"), lex).withColumnRenamed("key", "toxic"))
    return lex


def score(x: Column, y: Column, curve: tuple[float, ...]) -> Column:
    a, b, c = curve
    z = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.lit(a) + F.lit(b) * x + F.lit(c) * y))
    return 1 / (1 + F.exp(-z))


def detect(docs: DataFrame, labels: DataFrame, most_labels: int = 1_000_000, **options) -> DataFrame:
    """docs: doc_id, text; labels: doc_id, toxic. Learns from rows outside fold 0; returns doc_id, held_out, score, predicted.

    All texts are measured once, by the lexicon; the labelled rows among them give the curve, and it scores all of them.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    known = labels.where((fold("doc_id") != 0) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("l_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = settle(known)
    share = int(min(1.0, most_labels / max(1, known.count())) * (1 << 30))
    drawn = F.broadcast(known.where(F.pmod(F.xxhash64("l_id"), F.lit(1 << 30)) < share))
    labelled = F.col("doc_id") == F.col("l_id")
    lex = lexicon(docs.join(drawn, labelled).select("text", "toxic"), **options)
    found = measure(docs.withColumnRenamed("doc_id", "key"), lex).withColumnRenamed("key", "doc_id")
    found = Scratch(docs.sparkSession).keep(found, "weights")
    curve = curve_of(found.join(drawn, labelled).select("x", "y", "toxic"))
    out = found.select("doc_id", (fold("doc_id") == 0).alias("held_out"), score(F.col("x"), F.col("y"), curve).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
