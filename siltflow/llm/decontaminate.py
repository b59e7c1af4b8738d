"""Benchmark decontamination by template canonicalisation.

Texts become sequences of canonical tokens: numbers, names (capitalised words inside a sentence) and units after a
number are typed placeholders, everything else is a lower-case word; neighbouring numbers or names are one slot.
A capitalised word that begins a sentence is read as a word, and in a second reading of the text as a name, if it is
one inside a sentence within NEAR tokens; in a third reading there are no names, so that it doesn't depend on case. The
readings are matched apart. Windows of `width` tokens are hash-joined
with the windows of the benchmark: as templates if they have at least `literal` words, or DISTINCT different ones,
else with the values of their slots. A template's hit carries the values of its slots: one value of the item must stand for one value of the
document, so that re-parameterised questions match and chance templates don't. This is decided for each alignment
(place in the document less place in the item), for bands of BAND neighbouring alignments, as of copies with words
put in or left out, and for the whole document. A document is contaminated by an item if consistent windows of one of
these cover `run` tokens of it, or half of its windows. Items shorter than `width` are windows of their own length;
items of fewer than three tokens match documents that are nothing else.

A bit table of the benchmark's windows is broadcast to drop most other windows before the join. Its size follows from
their number up to 2 ** MOST_BITS bits; beyond that it drops fewer, with the same result. The join itself is left to
Spark, which broadcasts the benchmark side only below its own size limit.

Null or empty texts match nothing. A verdict depends on the text alone: verdicts() names rows by 128 bits of a hash of
it, so repeated and null ids neither share verdicts nor go without. Ties and repeated benchmark items: all items are listed. Empty tables give clean documents, or
no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import settle, table
from .tokens import U, chunks, mix64, powers, prefix, spans_hash

#: Words that are units after a number.
UNITS = """mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers g kg mg lb lbs oz gram grams
kilogram kilograms pound pounds ounce ounces ton tons l ml liter liters litre litres gallon gallons s sec ms min h hr second seconds minute minutes hour hours
day days week weeks month months year years mph kmh hz khz mhz ghz w kw v volt volts watt watts j joule joules n newton newtons c f k degrees degree percent
dollar dollars cent cents euro euros usd eur gbp b kb mb gb tb""".split()
WORD, NUMBER, NAME, UNIT = range(4)
LEAST_BITS, MOST_BITS = 22, 26
NEAR, BAND, DISTINCT = 200, 16, 3
BASE = 0xD1342543DE82EF95
_B = np.arange(256)
CORE = (_B >= 128) | ((_B >= 48) & (_B <= 57)) | ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122))
_DIGIT, _UPPER, _LOWERED = (_B >= 48) & (_B <= 57), (_B >= 65) & (_B <= 90), np.where((_B >= 65) & (_B <= 90), _B + 32, _B).astype(np.uint8)
_STOP = np.isin(_B, np.frombuffer(b".!?:\n", np.uint8))


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case in UTF-8, where it is as long as upper case: by table for ASCII and the Latin-1 letters."""
    out = _LOWERED[data]
    if len(data) and (data >= 0xC4).any():
        same = lambda c: x if len((x := c.lower()).encode()) == len(c.encode()) else c
        return np.frombuffer("".join(map(same, data.tobytes().decode())).encode(), np.uint8)
    i = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    out[i] += 0x20
    return out


def _word_hashes(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    return mix64(spans_hash(prefix(data), ends - [len(w) for w in words], ends))


_UNIT_HASHES = np.sort(_word_hashes(UNITS))


def near_names(row: np.ndarray, own: np.ndarray, name: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which of the asked tokens are the same word as a name of their row within NEAR tokens."""
    at = np.flatnonzero(name | asked)
    key = mix64(own[at] ^ mix64(row[at].astype(np.uint64) + U(1)))
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    out = np.zeros(len(own), bool)
    for step in (1, -1):
        a, k, is_name = at[::step], key[::step], name[at[::step]]
        last = np.maximum.accumulate(np.where(is_name, np.arange(len(a)), -1))
        found = (last >= 0) & (k[last] == k) & (np.abs(a[last] - a) <= NEAR)
        out[a[found]] = True
    return out & asked


class Tokens:
    """The tokens of a chunk: row, start, end, hash of the lower-cased word, and what tells numbers, names and units."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        core = np.r_[False, CORE[data], False]
        cut = np.zeros(len(data) + 1, bool)
        cut[offs] = True
        self.n_rows, self.sums = len(offs) - 1, prefix(lowered(data) if len(data) else data)
        start = self.start = np.flatnonzero(core[1:-1] & (~core[:-2] | cut[:-1]))
        end = self.end = np.flatnonzero(core[1:-1] & (~core[2:] | cut[1:])) + 1
        self.own = mix64(spans_hash(self.sums, start, end))
        row = self.row = np.searchsorted(offs, start, "right") - 1
        digits = np.r_[0, np.cumsum(_DIGIT[data])]
        self.number = digits[end] > digits[start]
        self.name = self.begins = np.zeros(len(row), bool)
        if len(row):
            latin1 = lambda i: (data[i] == 0xC3) & (data[np.minimum(i + 1, len(data) - 1)] >= 0x80) & (data[np.minimum(i + 1, len(data) - 1)] <= 0x9E)
            upper = _UPPER[data[start]] | latin1(start)
            second = np.minimum(start + 1 + (data[start] >= 0xC0), np.maximum(end - 1, start))
            shout = (second > start) & (_UPPER[data[second]] | latin1(second))
            stops = np.r_[0, np.cumsum(_STOP[data])]
            first = np.r_[True, row[1:] != row[:-1]] | (stops[start] > stops[np.minimum(np.r_[0, end[:-1]], start)])
            name = upper & ~self.number & ~shout & (end - start > 1)
            self.name, self.begins = name & ~first, name & first

    def reading(self, k: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: row, kind, hash of the word itself; slots of several words have one token with their joint hash.
        k = 1: with names that begin sentences; 2: without names; each of the rows only that differ by it."""
        start, end, own, row, number, name = self.start, self.end, self.own, self.row, self.number, self.name
        if k:
            begins = near_names(row, own, name, self.begins) if k == 1 else name
            some = np.zeros(self.n_rows + 1, bool)
            some[row[begins]] = True
            keep = np.flatnonzero(some[row])
            start, end, own, row, number, name = (x[keep] for x in (start, end, own, row, number, (name | begins) & (k == 1)))
        kind = np.where(number, NUMBER, np.where(name, NAME, WORD))
        if len(kind) > 1:
            after = np.flatnonzero(number[:-1] & (row[1:] == row[:-1])) + 1
            at = np.minimum(np.searchsorted(_UNIT_HASHES, own[after]), len(_UNIT_HASHES) - 1)
            kind[after[(kind[after] == WORD) & (_UNIT_HASHES[at] == own[after])]] = UNIT
            joined = np.r_[False, (row[1:] == row[:-1]) & (kind[1:] == kind[:-1]) & ((kind[1:] == NUMBER) | (kind[1:] == NAME)) & (start[1:] - end[:-1] == 1)]
            if joined.any():
                keep = np.flatnonzero(~joined)
                last = np.r_[keep[1:] - 1, len(kind) - 1]
                own = mix64(spans_hash(self.sums, start[keep], end[last]))
                row, kind = row[keep], kind[keep]
        return row, kind, own


def windows(row: np.ndarray, kind: np.ndarray, own: np.ndarray, width: int, literal: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of windows of width tokens, the index of their first tokens, and whether slots are hashed by value, not
    by kind: in windows of fewer than `literal` words, unless DISTINCT of these differ."""
    n = len(row)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    h = np.where(kind == WORD, own, mix64(kind.astype(np.uint64)))
    size = 1 << (n + 1).bit_length()
    total = np.r_[U(0), np.cumsum(h * powers(BASE, size)[:n])]
    words = np.r_[0, np.cumsum(kind == WORD)]
    i = np.flatnonzero(row[: n - width + 1] == row[width - 1 :])
    few = words[i + width] - words[i] < literal
    over = total[i + width] - total[i]
    at = np.flatnonzero(few)
    if len(at):
        index = i[at][:, None] + np.arange(width)
        own_words = np.sort(np.where(kind[index] == WORD, own[index], U(0)), axis=1)
        differ = ((own_words[:, 1:] != own_words[:, :-1]) & (own_words[:, 1:] != 0)).sum(1) + (own_words[:, 0] != 0)
        few[at] = differ < DISTINCT
        valued = np.r_[U(0), np.cumsum(own * powers(BASE, size)[:n])]
        over[few] = (valued[i + width] - valued[i])[few]
    return mix64(mix64(over * powers(pow(BASE, -1, 1 << 64), size)[i]) + U(width) + few.astype(np.uint64) * U(1 << 32)), i, few


def slots(at: np.ndarray, kind: np.ndarray, own: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Own hashes of the slots of windows that begin at `at`, flat, and how many each window has."""
    index = at[:, None] + np.arange(width)
    slot = kind[index] != WORD
    return own[index][slot].view(np.int64), slot.sum(1)


def template_windows(texts: DataFrame, widths: list[tuple[int, int]], whole: bool = False, table: np.ndarray | None = None) -> DataFrame:
    """texts: id, text. Returns key, reading, valued, id, pos, slots for each (width, least words). whole: windows of all widths but the
    first only where they are a whole text, as those of fewer than three tokens always are. table: packed bits of the keys that matter."""
    shipped = texts.sparkSession.sparkContext.broadcast(table)
    kind_of_id = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for lo, hi, data, offs in chunks(batch.column(1)):
                    tokens = Tokens(data, offs)
                    readings = [tokens.reading(r) for r in range(3)]
                    named = np.zeros(hi - lo, bool)
                    named[readings[2][0]] = True
                    for reading, i, (width, literal) in ((r, i, w) for r in range(3) for i, w in enumerate(widths)):
                        row, kind, own = readings[reading]
                        n = np.bincount(row, minlength=hi - lo)
                        key, at, few = windows(row, kind, own, width, literal)
                        keep = n[row[at]] == width if whole and i or width < 3 else np.ones(len(at), bool)
                        if shipped.value is not None:
                            keep[keep] = all_set(shipped.value, key[keep])
                        if not whole:  # one hit of a window by value tells all, wherever it stands
                            once = np.flatnonzero(keep & few)
                            tag = key[once] ^ mix64(row[at[once]].astype(np.uint64) + U(1))
                            keep[once] = False
                            keep[once[np.unique(tag, return_index=True)[1]]] = True
                        key, at, few = key[keep], at[keep], few[keep]
                        # a text without names reads the same without them
                        for name, some in ((reading, np.ones(len(key), bool)), (2, ~named[row[at]])) if reading == 0 else ((reading, np.ones(len(key), bool)),):
                            if some.any():
                                flat, many = slots(at[some], kind, own, width)
                                values = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)].astype(np.int32)), pa.array(flat))
                                first = (np.cumsum(n) - n)[row[at[some]]]
                                yield pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), pa.array(np.full(int(some.sum()), name)), pa.array(few[some]), batch.column(0).take(pa.array(lo + row[at[some]])), pa.array(at[some] - first), values], ["key", "reading", "valued", "id", "pos", "slots"])

    return texts.select("id", "text").where("text is not null").mapInArrow(run, f"key bigint, reading bigint, valued boolean, id {kind_of_id}, pos bigint, slots array<bigint>")


def places(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each key in a table of 2 ** bits."""
    return (key & U((1 << bits) - 1)).astype(np.int64), (key >> U(64 - bits)).astype(np.int64)


def all_set(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    bits = (8 * len(table)).bit_length() - 1
    one, two = places(key, bits)
    out = (table[one >> 3] >> (one & 7)) & 1 == 1
    out[out] = (table[two[out] >> 3] >> (two[out] & 7)) & 1 == 1
    return out


def key_table(own: DataFrame, n: int) -> np.ndarray:
    """Packed bits of the keys; bytes are put together on the cluster, so at most 2 ** (MOST_BITS - 3) rows reach the driver."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(places(batch.column(0).to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 3), pa.array(1 << (at & 7))], ["byte", "bit"])

    found = own.select("key").mapInArrow(run, "byte bigint, bit bigint").groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 3), np.uint8)
    out[found.column("byte").to_numpy()] = found.column("bits").to_numpy()
    return out


def short_lengths(items: DataFrame, width: int) -> list[int]:
    """The lengths of items shorter than a window: at most width - 1 of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for lo, hi, data, offs in chunks(batch.column(0)):
                    tokens = Tokens(data, offs)
                    for reading in range(3):
                        yield pa.RecordBatch.from_arrays([pa.array(np.bincount(tokens.reading(reading)[0], minlength=hi - lo))], ["n"])

    return sorted(r["n"] for r in items.select("text").where("text is not null").mapInArrow(run, "n bigint").where((F.col("n") < width) & (F.col("n") >= 1)).distinct().collect())


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 8, literal: int = 5, run: int = 13) -> DataFrame:
    """docs: doc_id (of any type), text; benchmark: item_id, text. doc_id, item_id, n_windows (of the item, matched), item_windows; one row a pair."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("id"), "text")
    widths = [(width, literal), *((w, max(3, w - 3)) for w in short_lengths(items, width))]
    own = template_windows(items, widths, whole=True)
    own = settle(own.select("key", "reading", F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots")))
    hits = template_windows(docs.select(F.col("doc_id").alias("id"), "text").where("id is not null"), widths, table=key_table(own, own.count()))
    found = settle(hits.join(own, ["key", "reading"]).select(F.col("id").alias("doc_id"), "item_id", "reading", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"), "valued", F.arrays_zip("item_slots", "slots").alias("pairs")))  # read by three branches
    by = ["doc_id", "item_id", "reading"]
    equal = found.where("valued").groupBy(*by).agg(F.collect_set("item_pos").alias("equal"))
    # alignments: each alone, in two bands of neighbours, and all of the document
    band = lambda code, at: F.struct(F.lit(code).alias("of"), at.cast("bigint").alias("at"))
    bands = [band(0, F.col("shift")), band(1, F.floor(F.col("shift") / BAND)), band(2, F.floor((F.col("shift") + BAND // 2) / BAND)), band(3, F.lit(0))]
    found = found.where("not valued").withColumn("part", F.explode(F.array(*bands)))
    by_part = [*by, "part"]
    # each value of the item stands for the value of this part of the document that it is most often paired with
    votes = found.select(*by_part, F.explode("pairs").alias("p")).groupBy(*by_part, "p.item_slots", "p.slots").agg(F.count("*").alias("n"))
    usual = votes.groupBy(*by_part, "item_slots").agg(F.max(F.struct("n", "slots"))["slots"].alias("usual"))
    usual = usual.groupBy(*by_part).agg(F.map_from_entries(F.collect_list(F.struct("item_slots", "usual"))).alias("map"))
    agreed = F.forall("pairs", lambda p: F.element_at("map", p["item_slots"]) == p["slots"])
    sound = found.join(usual, by_part, "left").where((F.size("pairs") == 0) | agreed)
    alike = sound.groupBy(*by_part).agg(F.collect_set("item_pos").alias("alike"))
    none = F.array().cast("array<bigint>")
    per = alike.join(equal, by, "full").select(*by, F.size(F.array_union(F.coalesce("alike", none), F.coalesce("equal", none))).cast("bigint").alias("n_windows"))
    sizes = own.groupBy("item_id", "reading").agg(F.countDistinct("item_pos").alias("item_windows"))
    enough = (F.col("n_windows") >= run - width + 1) | (2 * F.col("n_windows") >= F.col("item_windows"))
    most = per.join(sizes, ["item_id", "reading"]).where(enough).groupBy("doc_id", "item_id").agg(F.max(F.struct("n_windows", "item_windows")).alias("most"))
    return most.select("doc_id", "item_id", "most.n_windows", "most.item_windows")


def text_key() -> Column:
    """128 bits of a hash of the text."""
    return F.when(F.col("text").isNotNull(), F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(9), "text").alias("b")))


def verdicts(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each row of docs: doc_id, contaminated, items (ids, ascending), n_windows (the most of one item)."""
    docs = docs.select("doc_id", "text")
    per = contaminated(docs.select(text_key().alias("doc_id"), "text"), benchmark, **options).groupBy(F.col("doc_id").alias("c_key")).agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max("n_windows").alias("n_windows"))
    out = docs.select(F.col("doc_id").cast("bigint"), text_key().alias("key")).join(per, F.col("key") == F.col("c_key"), "left")
    return out.select("doc_id", F.col("c_key").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("n_windows", F.lit(0)).cast("bigint").alias("n_windows"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
