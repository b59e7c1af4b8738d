"""Language-model scoring by Katz backoff.

Bigram counts are discounted by Good-Turing, on smoothed counts of counts; the mass that a history loses goes to its unseen words in proportion to
the discounted unigrams, by a backoff weight that normalises exactly: a(v) = (1 - sum of seen P(w|v)) / (1 - sum of
their P(w)). Unigrams back off once more, to a uniform share of the unseen mass for as many unseen types as there are
seen ones. A token is evaluated recursively: bigram if seen, else a(v) times the unigram, else the unseen share.

No table is small here, so look-ups are requests. Texts are tokenised once, in batches: a batch has the sorted hashes
of its different words and its texts as indices into them. Words, then word pairs, are sent to the part of the count
tables that has them, each once a batch; the part counts, and answers every batch in the order of its request. Tables
are partitioned by the history's hash, so a part sees all words after a history and can sum their P(w); histories with
over `hot_share` of all tokens, of which there are at most 1 / hot_share, are dealt by pair instead, and their sums are
added up. The encoded batches are a bucketed table, so answers come to them without moving them.

Null texts are empty: one end token. Text is split at ASCII white space; A-Z are lowered. Repeated rows are scored, and
counted, each; null ids are scored and fall into the fold of the empty id. Without training rows every probability is
that of an unseen token, 0.5 for each of two types (score), and the contract's base formula holds with c = N = V = 0.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import atexit
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import Scratch, fold, settle, table
from .tokens import LOWER, U, Words, chunks, mix64

END, START = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC6A4A7935BD1E995)
#: Counts up to this are discounted.
K = 5
BATCH = 16 << 20
#: Tokens whose counts one part of the tables, which one task holds, has on average; the number of parts follows.
PART = 1_500_000


def pack(*arrays: np.ndarray) -> bytes:
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<2sI", np.dtype(a.dtype).str[1:].encode(), len(a)) for a in arrays)
    return zstandard.compress(head + b"".join(a.tobytes() for a in arrays), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    out, at = [], 1 + 6 * raw[0]
    for i in range(raw[0]):
        kind, n = struct.unpack_from("<2sI", raw, 1 + 6 * i)
        out.append(np.frombuffer(raw, np.dtype("<" + kind.decode()), n, at))
        at += out[-1].nbytes
    return out


def encode(docs: DataFrame) -> DataFrame:
    """docs: doc_id, held, text. batch; data: ids, whether null, held, tokens of each text, hashes of the words, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, held, size
            ids, null, out, n, h = (np.concatenate(x) for x in zip(*held))
            words = np.unique(np.r_[h, START])
            data = pack(ids, null, out, n, words, np.searchsorted(words, h).astype(np.uint32))
            row = pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() << 32 | seq]), pa.array([len(h)]), pa.array([data], pa.binary())], ["batch", "n", "data"])
            seq, held, size = seq + 1, [], 0
            return row

        with np.errstate(over="ignore"):
            for b in batches:
                ids = b.column(0).fill_null(0).to_numpy()
                null = b.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
                out = b.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
                for lo, hi, data, offs in chunks(b.column(2)):
                    w = Words(data, offs)
                    n = w.per_row + 1
                    tokens = np.full(len(w.start) + hi - lo, END)
                    tokens[np.arange(len(w.start)) + w.row] = w.hashes(LOWER)
                    held.append((ids[lo:hi], null[lo:hi], out[lo:hi], n.astype(np.uint32), tokens))
                    size += len(data)
                    if size >= BATCH:
                        yield flush()
            if held:
                yield flush()

    return docs.select(F.col("doc_id").cast("bigint"), "held", "text").mapInArrow(run, "batch bigint, n bigint, data binary")


class Batch:
    """An encoded batch with its pairs of neighbours; index of a pair: history * words + word."""

    def __init__(self, data: bytes):
        self.ids, self.null, self.held, self.n, self.words, self.tokens = unpack(data)
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        self.trains = self.held[self.row] == 0

    def word_counts(self) -> np.ndarray:
        out = np.bincount(self.tokens[self.trains], minlength=len(self.words))
        out[np.searchsorted(self.words, START)] = int((self.held == 0).sum())  # how often START is a history
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """History, word and training count of each different pair, sorted; and the pair of each token."""
        before = np.r_[np.uint32(0), self.tokens[:-1]]
        before[np.cumsum(self.n) - self.n] = np.searchsorted(self.words, START)
        key = before.astype(np.uint64) * U(len(self.words)) + self.tokens
        order = np.argsort(key)
        sorted_ = key[order]
        new = np.r_[True, sorted_[1:] != sorted_[:-1]]
        at = np.empty(len(key), np.int64)
        at[order] = np.cumsum(new) - 1
        distinct = sorted_[new]
        count = np.bincount(at[self.trains], minlength=len(distinct))
        return (distinct // U(len(self.words))).astype(np.int64), (distinct % U(len(self.words))).astype(np.int64), count, at


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The part that has a hash: its high bits, so sorted hashes lie in order of their parts."""
    return (h >> U(64 - parts.bit_length() + 1)).astype(np.int64) if parts > 1 else np.zeros(len(h), np.int64)


REPLY = "kind string, part int, batch bigint, data binary"


def _rows(rows: list[tuple]) -> pa.Table:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary())
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["kind", "part", "batch", "data"])


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys, their sums, and the place of each input key among them."""
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(at, np.concatenate(counts), len(distinct)).astype(np.int64), at


def _runs(part: np.ndarray) -> list[tuple[int, int, int]]:
    """Value, start and end of each run."""
    start = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    return [(int(part[i]), int(i), int(j)) for i, j in zip(start, np.r_[start[1:], len(part)])]


def _histogram(counts: np.ndarray) -> np.ndarray:
    return np.bincount(counts[(counts > 0) & (counts <= K + 1)], minlength=K + 2).astype(np.int64)


def _merged_stats(replies: DataFrame) -> list[list[np.ndarray]]:
    """The packed arrays of replies 's', added up by task: the first array as it is, the rest by the keys in the second.
    What reaches the driver is a row for each task, and of hot histories at most 1 / hot_share in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, keys, rest = None, np.zeros(0, np.uint64), []
        for b in batches:
            for x in b.column(0):
                first, *more = unpack(x.as_py())
                total = first.copy() if total is None else total + first
                if more:
                    keys, at = np.unique(np.r_[keys, more[0]], return_inverse=True)
                    rest = [np.bincount(at, np.r_[r, m], len(keys)) for r, m in zip(rest or [np.zeros(0)] * len(more[1:]), more[1:])]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pack(total, keys, *rest)], pa.binary())], ["data"])

    return [unpack(r["data"]) for r in replies.where("kind = 's'").select("data").mapInArrow(run, "data binary").collect()]


def ask_words(encoded: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in batches:
                for batch, data in zip(b.column(0).to_pylist(), b.column(1)):
                    x = Batch(data.as_py())
                    count = x.word_counts().astype(np.uint32)
                    yield from _rows([("w", p, batch, pack(x.words[i:j], count[i:j])) for p, i, j in _runs(part_of(x.words, parts))]).to_batches()

    return encoded.select("batch", "data").mapInArrow(run, REPLY)


def count_words(asked: DataFrame) -> DataFrame:
    """Answers 'w': counts; and 's': N, V, the numbers of words with each low count, of one part."""

    def run(t: pa.Table) -> pa.Table:
        sent = [unpack(x.as_py()) for x in t.column("data")]
        words, count, at = _merged([s[0] for s in sent], [s[1] for s in sent])
        real = count[words != START]
        part = t.column("part")[0].as_py()
        rows = [("s", part, -1, pack(np.r_[real.sum(), (real > 0).sum(), _histogram(real)].astype(np.int64)))]
        cut = np.cumsum([0] + [len(s[0]) for s in sent])
        rows += [("w", part, b, pack(count[at[i:j]].astype(np.uint64))) for b, i, j in zip(t.column("batch").to_pylist(), cut, cut[1:])]
        return _rows(rows)

    return asked.groupBy("part").applyInArrow(run, REPLY)


#: The slope of smoothed counts of counts is at most this; Good-Turing lowers no count where they fall as 1 / c or slower.
LEAST_SLOPE = -1.05


def discounts(histogram: np.ndarray) -> np.ndarray:
    """d[c] for c = 0 ... K (d[0] unused): Katz's Good-Turing ratios of smoothed counts of counts.

    The logarithms of the counts of counts are fitted by a line in log c, as single ones are too uneven for the ratios.
    On the line, with slope b, c* / c = ((c + 1) / c) ** (b + 1), so all ratios lie between 0 and 1 if b < -1.
    """
    c = np.arange(1, K + 2)
    some = histogram[1 : K + 2] > 0
    x, y = np.log(c[some]), np.log(histogram[1 : K + 2][some].astype(float))
    slope = -2.0 if some.sum() < 2 else ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
    power = min(slope, LEAST_SLOPE) + 1
    last = (K + 1.0) ** power
    return np.r_[1.0, (((c[:-1] + 1) / c[:-1]) ** power - last) / (1 - last)]


def unigram(count: np.ndarray, m: dict) -> np.ndarray:
    """P(w) by the word's count."""
    total, types, d, unseen = m["total"] + m["spare"], m["types"], m["d1"], m["unseen"]
    return np.where(count > 0, np.where(count <= K, d[np.minimum(count, K)], 1.0) * count / max(total, 1), unseen / max(types, 2))


def is_hot(count: np.ndarray, total: int, share: float) -> np.ndarray:
    return count > max(1, total) * share


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix64(v ^ mix64(w))


def split_pairs(x: Batch, count: np.ndarray, total: int, share: float) -> tuple[np.ndarray, ...]:
    """The batch's pairs; the places of those with other histories, in order; and of hot ones, by hash of the pair."""
    v, w, n, at = x.pairs()
    hot = is_hot(count, total, share)[v]
    cold, warm = np.flatnonzero(~hot), np.flatnonzero(hot)
    return v, w, n, at, cold, warm[np.argsort(pair_keys(x.words[v[warm]], x.words[w[warm]]))]


def _by_batch(encoded: DataFrame, replies: DataFrame, run, schema: str) -> DataFrame:
    return encoded.select("batch", "data").groupBy("batch").cogroup(replies.groupBy("batch").agg(F.collect_list(F.struct("kind", "part", "data")).alias("r")).groupBy("batch")).applyInArrow(run, schema)


def _replies(t: pa.Table) -> dict[str, list[list[np.ndarray]]]:
    """Answers by kind, in order of parts."""
    out: dict[str, list] = {}
    for r in sorted(t.column("r")[0].as_py(), key=lambda r: r["part"]):
        out.setdefault(r["kind"], []).append(unpack(r["data"]))
    return out


def _whole(replies: list[list[np.ndarray]], i: int) -> np.ndarray:
    return np.concatenate([r[i] for r in replies]) if replies else np.zeros(0, np.int64)


def ask_pairs(encoded: DataFrame, words: DataFrame, model: dict, parts: int) -> DataFrame:
    """Requests 'p' (histories, words after each, words, training counts, counts of the words) and 'h' for hot histories."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        with np.errstate(over="ignore"):
            for batch, data in zip(left.column("batch").to_pylist(), left.column("data")):
                x = Batch(data.as_py())
                count = _whole(_replies(right)["w"], 0).astype(np.int64)
                v, w, n, _, cold, warm = split_pairs(x, count, model["total"], model["hot_share"])
                hv, hw, seen = x.words[v], x.words[w], count[w].astype(np.uint64)
                for kind, places, at in (("p", cold, part_of(hv[cold], parts)), ("h", warm, part_of(pair_keys(hv[warm], hw[warm]), parts))):
                    for p, i, j in _runs(at):
                        k = places[i:j]
                        if kind == "p":
                            first = np.flatnonzero(np.r_[True, v[k][1:] != v[k][:-1]])
                            rows.append((kind, p, batch, pack(hv[k][first], np.diff(np.r_[first, len(k)]).astype(np.uint32), hw[k], n[k].astype(np.uint32), seen[k])))
                        else:
                            rows.append((kind, p, batch, pack(hv[k], hw[k], n[k].astype(np.uint32), seen[k])))
        return _rows(rows)

    return _by_batch(encoded, words, run, REPLY)


def _sums(history: np.ndarray, n: int, c: np.ndarray, p: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each of n histories: how many seen words have count 1 ... K, and the sum of the seen words' P."""
    low = [np.bincount(history[c == k], minlength=n).astype(np.uint32) for k in range(1, K + 1)]
    return low, np.bincount(history[c > 0], p[c > 0], n)


def count_pairs(asked: DataFrame, model: dict) -> DataFrame:
    """Answers 'p' (pair counts; of each history the numbers of low counts and the sum of P), 'h' (pair counts), and 's':
    numbers of pairs with low counts, and the hot histories' sums of this part."""

    def run(t: pa.Table) -> pa.Table:
        part, rows, low = t.column("part")[0].as_py(), [], np.zeros(K + 2, np.int64)
        hot = [np.zeros(0, np.uint64), np.zeros(0, np.float64), *(np.zeros(0, np.uint32) for _ in range(K))]
        with np.errstate(over="ignore"):
            for kind in ("p", "h"):
                mine = [(b, unpack(d)) for k, b, d in zip(t.column("kind").to_pylist(), t.column("batch").to_pylist(), t.column("data").to_pylist()) if k == kind]
                if not mine:
                    continue
                if kind == "p":
                    v = [np.repeat(s[0], s[1]) for _, s in mine]
                    w, n, seen = ([s[i] for _, s in mine] for i in (2, 3, 4))
                else:
                    v, w, n, seen = ([s[i] for _, s in mine] for i in range(4))
                allv, allw = np.concatenate(v), np.concatenate(w)
                order = np.lexsort((allw, allv))
                sv, sw = allv[order], allw[order]
                new = np.r_[True, (sv[1:] != sv[:-1]) | (sw[1:] != sw[:-1])]
                at = np.empty(len(order), np.int64)
                at[order] = np.cumsum(new) - 1
                c = np.bincount(at, np.concatenate(n)).astype(np.int64)
                low += _histogram(c)
                seen_of = np.concatenate(seen)[order][new].astype(np.int64)
                p = unigram(seen_of, model)
                names, history = np.unique(sv[new], return_inverse=True)
                counts, sums = _sums(history, len(names), c, p)
                cut = np.cumsum([0] + [len(x) for x in v])
                for (b, s), i, j in zip(mine, cut, cut[1:]):
                    out = [c[at[i:j]].astype(np.uint32)]
                    if kind == "p":
                        place = np.searchsorted(names, s[0])
                        out += [sums[place], *(x[place] for x in counts)]
                    rows.append((kind, part, b, pack(*out)))
                if kind == "h":
                    hot = [names, sums, *counts]
        rows.append(("s", part, -1, pack(low, *hot)))
        return _rows(rows)

    return asked.groupBy("part").applyInArrow(run, REPLY)


def weights(c: np.ndarray, sums: np.ndarray, low: list[np.ndarray], d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of histories with counts c: the denominator of seen pairs, and the backoff weight. A history that loses nothing gets one more in its denominator."""
    kept = c - sum(x * (k * (1 - d2[k])) for k, x in enumerate(low, 1))
    whole = np.where(kept > c - 1e-9, c + 1.0, c)
    with np.errstate(divide="ignore", invalid="ignore"):
        return whole, np.where(c > 0, (1 - kept / whole) / (1 - sums), 1.0)


RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score_batches(encoded: DataFrame, replies: DataFrame, model: dict) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        m, tables = model, []
        with np.errstate(over="ignore"):
            for data in left.column("data"):
                x, r = Batch(data.as_py()), _replies(right)
                count = _whole(r["w"], 0).astype(np.int64)
                v, w, _, at, cold, warm = split_pairs(x, count, m["total"], m["hot_share"])
                c = np.zeros(len(v), np.int64)
                c[cold], c[warm] = _whole(r.get("p", []), 0), _whole(r.get("h", []), 0)
                sums, low = np.zeros(len(x.words)), [np.zeros(len(x.words)) for _ in range(K)]
                named = np.unique(v[cold])
                sums[named] = _whole(r.get("p", []), 1)
                for k in range(K):
                    low[k][named] = _whole(r.get("p", []), 2 + k)
                if len(warm):
                    named = np.unique(v[warm])
                    place = np.searchsorted(m["hot"][0], x.words[named])
                    sums[named] = m["hot"][1][place]
                    for k in range(K):
                        low[k][named] = m["hot"][2 + k][place]
                whole, back = weights(count.astype(float), sums, low, m["d2"])
                p1 = unigram(count, m)
                d = np.where(c <= K, m["d2"][np.minimum(c, K)], 1.0)
                log = np.log10(np.where(c > 0, d * c / np.maximum(whole[v], 1), back[v] * p1[w]))
                base = np.log10((count + 0.5) / (m["total"] + 0.5 * (m["types"] + 1)))
                docs = len(x.n)
                columns = [
                    pa.array(x.ids, mask=x.null.astype(bool)), pa.array(x.held.astype(bool)), pa.array(x.n.astype(np.int64)), pa.array(np.bincount(x.row, count[x.tokens] > 0, docs).astype(np.int64)),
                    pa.array(np.full(docs, m["total"], np.int64)), pa.array(np.bincount(x.row, base[x.tokens], docs)), pa.array(np.bincount(x.row, log[at], docs)),
                ]
                tables.append(pa.table(columns, names=[f.split()[0] for f in RESULT.split(", ")]))
        return pa.concat_tables(tables)

    return _by_batch(encoded, replies, run, RESULT)


def score(docs: DataFrame, hot_share: float = 0.001) -> DataFrame:
    """docs: doc_id, held, text; learns from rows that aren't held. RESULT, one row for each row of docs."""
    spark = docs.sparkSession
    scratch, name = Scratch(spark), f"katz_{uuid.uuid4().hex}"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    encode(docs).write.option("compression", "uncompressed").bucketBy(buckets, "batch").format("parquet").saveAsTable(name)
    atexit.register(lambda: spark.sparkContext._jsc is not None and spark.sql(f"DROP TABLE IF EXISTS {name}"))
    encoded = spark.table(name)
    tokens = encoded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = 1 << (tokens // PART).bit_length()
    words = scratch.keep(count_words(ask_words(encoded, parts)), "words")
    stats = sum((s[0] for s in _merged_stats(words)), np.zeros(K + 4, np.int64))
    total, types, histogram = int(stats[0]), int(stats[1]), stats[2:]
    d1 = discounts(histogram)
    lost = sum(float(histogram[c]) * c * (1 - d1[c]) for c in range(1, K + 1))
    spare = 0 if lost > 0 else 1  # without low counts, one token's worth is left for unseen words
    model = {"total": total, "types": types, "spare": spare, "d1": d1, "unseen": (lost + spare) / (total + spare) if total else 1.0, "hot_share": hot_share}
    answers = words.where("kind = 'w'")
    pairs = scratch.keep(count_pairs(ask_pairs(encoded, answers, model, parts), model), "pairs")
    low, hot = np.zeros(K + 2, np.int64), {}
    for x in _merged_stats(pairs):
        low = low + x[0]
        for i, v in enumerate(x[1]):
            hot[v] = hot.get(v, np.zeros(K + 1)) + np.array([x[2 + k][i] for k in range(K + 1)])
    names = np.array(sorted(hot), np.uint64)
    stacked = np.array([hot[v] for v in names]).reshape(len(names), K + 1)
    model |= {"d2": discounts(low), "hot": [names, *(stacked[:, k] for k in range(K + 1))]}
    out = settle(score_batches(encoded, answers.unionByName(pairs.where("kind <> 's'")), model))
    scratch.close()
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return out


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs.select("doc_id", (fold("doc_id") == 1).alias("held"), "text"))
