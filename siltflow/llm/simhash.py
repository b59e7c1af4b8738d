"""SimHash near-duplicates by tiled exact comparison.

A fingerprint bit is 1 if it is set in over half of the hashes of the text's word shingles. Distinct fingerprints are
compared exactly: numpy exclusive-or and bit counts over tiles sorted by population count; tile pairs whose population
counts lie further apart than the radius are skipped, and so are pairs of tiles already joined. Tiles are formed
within blocks, of which no pair within reach can miss all:

* fingerprints(): XXH64 of each shingle, repeats counted. A pair within radius r agrees on one of r + 1 blocks of bits.
* set_prints(): 256 bits of a set of shingles, to find candidates for an exact Jaccard similarity. The radius is five
  deviations above the mean distance at that similarity, so no block of bits is long enough. Blocks are shingles
  instead: in any order of all shingles, two sets of similarity t share one of the first n - ceil(t * n) + 1 of theirs.
  Shingles that a sketch of all documents finds frequent come last in that order, so common passages make no blocks.
  Shingles that are firsts of the same sets make one block. Two candidates are linked only if the exact similarity of their
  shingle sets is at least the ratio.

Block values of more than `most` fingerprints go to a grid: rows are dealt to stripes and every pair of stripes is a
task of bounded size. A task returns a spanning forest of its links, never all pairs; components() joins the forests.

Null or wordless text: fingerprint zero, linked like any other. Equal fingerprints (or sets), so repeated rows, ties
and rows without an id, are one node; a row without an id links others and gets the smallest id of its component,
null if there is none. An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .components import components, roots
from .shared import Scratch, settle, table
from .tokens import LOWER, U, Words, chunks, mix64, powers

TILE = 1024
#: Slots of the sketch of frequent shingles, and how many times the mean load a slot of one task has to be frequent.
SLOTS, OFTEN = 1 << 20, 8
BASE = 0xD1342543DE82EF95
#: Shingles of a task's side, some 8 bytes each, while sets are compared.
MOST_SHINGLES = 4_000_000
#: Of 256 bits, sets of 4 and 5 shingles at similarity 0.8 differ in 48 on average, with a deviation of 6; larger ones in 41 at most.
SMALL, WIDER = 5, 8


def shingle_hashes(text: str | None, k: int, seed: int) -> np.ndarray:
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - k + 1)
    at = list(accumulate(map(len, words), lambda a, x: a + x + 1, initial=0))
    parts = [joined[s : e - 1] for s, e in zip(at, at[k:])] if len(words) > k else [joined]
    return np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in parts), np.uint64, n)


def majority(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of n[i] hashes; 0 for none."""
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    starts = np.cumsum(n) - n
    at = 0
    while at < len(some):  # about 100,000 hashes at once, as bits
        end = max(at + 1, int(np.searchsorted(starts[some], starts[some[at]] + 100_000)))
        rows = some[at:end]
        lo, hi = starts[rows[0]], starts[rows[-1]] + n[rows[-1]]
        bits = np.unpackbits(hashes[lo:hi].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.add.reduceat(bits, starts[rows] - lo, axis=0, dtype=np.int32)
        out[rows] = np.packbits(sums * 2 > n[rows, None], axis=1).view(">u8").ravel()
        at = end
    return out


def fingerprints(docs: DataFrame, k: int, seed: int) -> DataFrame:
    """doc_id, n (shingles), f0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f, held, size = [], [], [], 0
            for i, text in enumerate(batch.column(1)):
                held.append(shingle_hashes(text.as_py(), k, seed))
                n.append(len(held[-1]))
                size += n[-1]
                if size > 100_000 or i + 1 == len(batch):
                    f.append(majority(np.concatenate(held), np.array(n[-len(held) :], np.int64)).view(np.int64))
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(np.concatenate(f) if f else np.zeros(0, np.int64))], ["doc_id", "n", "f0"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n bigint, f0 bigint")


def shingle_arrays(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of k-word shingles of a chunk's texts, sorted, flat; and the size of each. A text of fewer words, if
    any, is one shingle."""
    w = Words(data, offs)
    h, n_rows = w.hashes(LOWER), len(offs) - 1
    size = 1 << (len(h) + 1).bit_length()
    total = np.r_[U(0), np.cumsum(h * powers(BASE, size)[: len(h)])]
    first = np.cumsum(w.per_row) - w.per_row
    many = np.where(w.per_row > 0, np.maximum(w.per_row - k + 1, 1), 0)
    row = np.repeat(np.arange(n_rows), many)
    i = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + first[row]
    long = np.minimum(w.per_row, k)[row]
    key = (total[i + long] - total[i]) * powers(pow(BASE, -1, 1 << 64), size)[i]
    key = mix64(mix64(key) + long.astype(np.uint64))
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])] if len(key) else np.zeros(0, bool)
    return key[new], np.bincount(row[new], minlength=n_rows)


def frequent(docs: DataFrame, k: int) -> np.ndarray:
    """The sketch: for each slot of shingle hashes, how often its shingles occur in sets, as a power of two; 0 for slots
    that no task finds outstanding. A task sends its outstanding slots only, so at most SLOTS / OFTEN of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(SLOTS, np.int64)
        with np.errstate(over="ignore"):
            for batch in batches:
                for _, _, data, offs in chunks(batch.column(0)):
                    count += np.bincount((shingle_arrays(data, offs, k)[0] & U(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        slot = np.flatnonzero(count >= OFTEN * (1 + count.mean()))
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(count[slot])], ["slot", "n"])

    found = docs.select("text").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.uint8)
    out[found.column("slot").to_numpy()] = np.log2(found.column("n").to_numpy()).astype(np.uint8)
    return out


def set_prints(docs: DataFrame, k: int, words: int, ratio: float) -> DataFrame:
    """doc_id, n (shingles, each once), digest (a sum over them, equal for equal sets), f0, f1 ..., and firsts: the
    shingles of which a set of that similarity has one of its own firsts."""
    seeds = [mix64(np.array([0x5EED + i], np.uint64))[0] for i in range(words)]
    rank = docs.sparkSession.sparkContext.broadcast(frequent(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = rank.value
        with np.errstate(over="ignore"):
            for batch in batches:
                for lo, hi, data, offs in chunks(batch.column(1)):
                    h, n = shingle_arrays(data, offs, k)
                    starts, some = np.cumsum(n) - n, n > 0
                    digest = np.zeros(hi - lo, np.uint64)
                    if some.any():
                        digest[some] = np.add.reduceat(mix64(h), starts[some])
                    prints = [majority(mix64(h ^ s), n) for s in seeds]
                    row = np.repeat(np.arange(hi - lo), n)
                    order = np.lexsort((h, often[(h & U(SLOTS - 1)).astype(np.int64)], row))
                    take = np.where(some, n - np.ceil(ratio * n - 1e-9).astype(np.int64) + 1, 0)
                    keep = np.arange(len(h)) - starts[row] < take[row]
                    firsts = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(take)].astype(np.int32)), pa.array(h[order][keep].view(np.int64)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(digest.view(np.int64)), *(pa.array(f.view(np.int64)) for f in prints), firsts], ["doc_id", "n", "digest", *(f"f{i}" for i in range(words)), "firsts"])

    schema = "doc_id bigint, n bigint, digest bigint, " + ", ".join(f"f{i} bigint" for i in range(words)) + ", firsts array<bigint>"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


_XOR, _COUNT, _SUM = np.empty(TILE * TILE // 4, np.uint64), np.empty(TILE * TILE // 4, np.uint8), np.empty(TILE * TILE // 4, np.uint8)


def near_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b (rows x words, a tile each) of all pairs within the radius. Three words are counted for all
    pairs, in buffers that stay in the cache; the rest only for pairs that may still be within."""
    shape, head = (len(a), len(b)), min(3, a.shape[1])
    xor, count, total = (x[: len(a) * len(b)].reshape(shape) for x in (_XOR, _COUNT, _SUM))
    for w in range(head):
        np.bitwise_xor(a[:, None, w], b[None, :, w], out=xor)
        np.bitwise_count(xor, out=count if w else total)
        if w:
            np.add(total, count, out=total)
    within = total <= radius
    if not within.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.nonzero(within)
    if a.shape[1] > head:
        keep = total[i, j] + np.bitwise_count(a[i, head:] ^ b[j, head:]).sum(1, dtype=np.int64) <= radius
        i, j = i[keep], j[keep]
    return i, j


def tile_roots(f: np.ndarray, n: np.ndarray, radius: int, ratio: float, other: int = 0, labels: np.ndarray | None = None, sets: list[np.ndarray] | None = None) -> np.ndarray:
    """Labels of rows of f (rows x words, uint64) joined by links; other > 0: only pairs of a row before and one from
    `other` on. ratio > 0: a link needs shingle counts of at least that quotient, and of the sets, if given, at least
    that similarity."""
    lab = np.arange(len(f)) if labels is None else labels
    count = np.bitwise_count(f).sum(1, dtype=np.int64)
    key = n if ratio else count
    far = (lambda lo, hi: lo < ratio * hi - 1e-9) if ratio else (lambda lo, hi: hi - lo > radius)
    sides = [np.arange(len(f))] * 2 if not other else [np.arange(other), np.arange(other, len(f))]
    sides = [s[np.argsort(key[s], kind="stable")] for s in sides]
    for a in range(0, len(sides[0]), TILE // 4):
        rows = sides[0][a : a + TILE // 4]
        for b in range(0 if other else a - a % TILE, len(sides[1]), TILE):
            cols = sides[1][b : b + TILE]
            if far(key[rows[-1]], key[cols[0]]):
                break
            reach = radius + WIDER * bool(ratio and min(key[rows[0]], key[cols[0]]) < SMALL)
            if len(np.unique(np.r_[lab[rows], lab[cols]])) == 1:  # joined already
                continue
            if far(key[cols[-1]], key[rows[0]]) or count[rows].min() - count[cols].max() > reach or count[cols].min() - count[rows].max() > reach:
                continue
            i, j = near_pairs(f[rows], f[cols], reach)
            if not len(i):
                continue
            i, j = rows[i], cols[j]
            m = lab[i] != lab[j]
            if ratio:
                m &= np.minimum(n[i], n[j]) >= ratio * np.maximum(n[i], n[j]) - 1e-9
            if sets is not None:
                lab = similar_roots(sets, i[m], j[m], ratio, lab)
            elif m.any():
                lab = roots(len(f), i[m], j[m], lab)
    return lab


def similar_roots(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, ratio: float, lab: np.ndarray, step: int = 256) -> np.ndarray:
    """Labels after linking those of the pairs i - j whose similarity is at least the ratio; pairs already joined are passed over."""
    while len(i):
        a, b, i, j = i[:step], j[:step], i[step:], j[step:]
        apart = lab[a] != lab[b]
        a, b = a[apart], b[apart]
        same = np.array([jaccard(sets[x], sets[y]) >= ratio - 1e-9 for x, y in zip(a.tolist(), b.tolist())], bool)
        if same.any():
            lab = roots(len(lab), a[same], b[same], lab)
            apart = lab[i] != lab[j]
            i, j = i[apart], j[apart]
    return lab


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays, each without repeats."""
    both = np.concatenate((a, b))
    both.sort()
    common = np.count_nonzero(both[1:] == both[:-1])
    return common / max(1, len(both) - common)


def _forest(node: np.ndarray, lab: np.ndarray) -> pa.RecordBatch:
    far = lab != np.arange(len(lab))
    return pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(node[lab[far]])], ["src", "dst"])


def _columns(t: pa.Table | pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    f = np.stack([t.column(f"f{i}").to_numpy().view(np.uint64) for i in range(width)], 1)
    return t.column("node").to_numpy(), t.column("n").to_numpy(), f


def on_grid(rows: DataFrame, size, width: int, radius: int, ratio: float, most: int) -> DataFrame:
    """Links of rows (key, node, n, f0 ..., perhaps shingles) within a key, by the size of their key, from which the number of stripes follows."""

    def grid(task: pa.Table) -> pa.Table:
        side = task.column("side").to_numpy()
        task = task.take(pa.array(np.argsort(side, kind="stable")))
        if not side.any() and task.column("s").to_numpy()[0] != task.column("o").to_numpy()[0]:
            return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64())})  # the other stripe is empty
        node, n, f = _columns(task, width)
        sets = None
        if "shingles" in task.column_names:
            lists = task.column("shingles").combine_chunks()
            flat, offs = lists.values.to_numpy(), lists.offsets.to_numpy()
            sets = [flat[a:b] for a, b in zip(offs, offs[1:])]
        return pa.Table.from_batches([_forest(node, tile_roots(f, n, radius, ratio, int((side == 0).sum()) if side.any() else 0, sets=sets))])

    g = F.greatest(F.lit(1), F.ceil(size / most)).cast("int")
    s = F.pmod(F.xxhash64("node"), g).cast("int")
    dealt = rows.withColumn("g", g).withColumn("s", s).withColumn("o", F.explode(F.expr("sequence(0, g - 1)")))
    dealt = dealt.withColumn("task", F.struct("key", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"))).withColumn("side", (F.col("s") > F.col("o")).cast("int"))
    return dealt.groupBy("task").applyInArrow(grid, "src bigint, dst bigint")


def bit_blocks(nodes: DataFrame, radius: int) -> DataFrame:
    """key, node: the radius + 1 blocks of f0, one of which two fingerprints within the radius share."""
    size = 64 // (radius + 1)
    cuts = [(i * size, 64 if i == radius else (i + 1) * size) for i in range(radius + 1)]
    parts = [F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(F.shiftleft("f0", 64 - hi), 64 - (hi - lo)).alias("v")) for i, (lo, hi) in enumerate(cuts)]
    return nodes.select(F.explode(F.array(*parts)).alias("key"), "node")


def shared_firsts(firsts: DataFrame) -> DataFrame:
    """firsts: node, firsts; a node may have several rows. key, node for shingles that are firsts of two nodes or more; of
    those with the same nodes, one."""
    keyed = firsts.select(F.explode("firsts").alias("v"), "node")
    shared = keyed.groupBy("v").agg(F.min("node").alias("one"), F.max("node").alias("other")).where("one <> other").select(F.col("v").alias("s"))
    blocks = settle(keyed.join(shared, F.col("v") == F.col("s"), "left_semi").distinct())
    alike = blocks.groupBy("v").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("who"))
    one = alike.groupBy("n", "who").agg(F.min("v").alias("one")).select("one")
    return blocks.join(one, F.col("v") == F.col("one"), "left_semi").select(F.struct(F.lit(0).alias("i"), "v").alias("key"), "node")


def block_links(nodes: DataFrame, blocks: DataFrame, width: int, radius: int, ratio: float, most: int) -> DataFrame:
    """Links (src, dst) that span, within each block (key, node), the groups of nodes (node, n, f0 ...) within the radius."""
    columns = ["node", "n", *(f"f{i}" for i in range(width))]
    keyed = blocks.join(nodes.select(*columns), "node").select("key", *columns)
    counts = settle(blocks.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > most))
    hot = counts.select(F.col("key").alias("k"), "size")
    cold = keyed.join(hot, F.col("key") == F.col("k"), "left_anti") if hot.head(1) else keyed

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool):
            t = pa.Table.from_batches(held).combine_chunks()
            key = np.stack([t.column("i").to_numpy().astype(np.int64), t.column("v").to_numpy()], 1)
            cut = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, len(key)]
            end = len(key) if last else cut[-2]
            held[:] = [] if last else t.slice(end).to_batches()
            if not end:
                return None
            node, n, f = _columns(t.slice(0, end), width)
            cut = cut[cut <= end]
            sizes = np.diff(cut)
            lab, of = np.arange(end), np.repeat(np.arange(len(sizes)), sizes)
            small = np.repeat(sizes <= 64, sizes)
            for k in range(1, min(64, int(sizes.max()))):
                m = np.flatnonzero((of[k:] == of[:-k]) & small[k:])
                m = m[np.bitwise_count(f[m] ^ f[m + k]).sum(1) <= radius]
                lab = roots(end, m, m + k, lab)
            for s, z in zip(cut[:-1][sizes > 64], sizes[sizes > 64]):
                lab[s : s + z] = s + tile_roots(f[s : s + z], n[s : s + z], radius, ratio)
            return _forest(node, lab)

        for batch in batches:
            held.append(batch)
            if sum(len(b) for b in held) > 100_000 and (out := flush(False)) is not None:
                yield out
        if held and (out := flush(True)) is not None:
            yield out

    found = cold.select("key.i", "key.v", *columns).repartition("i", "v").sortWithinPartitions("i", "v").mapInArrow(within, "src bigint, dst bigint")
    if hot.head(1):
        found = found.union(on_grid(keyed.join(hot, F.col("key") == F.col("k")).drop("k"), F.col("size"), width, radius, ratio, most))
    return found


def links(nodes: DataFrame, radius: int, most: int = 60_000) -> DataFrame:
    """Links (src, dst) that span the groups of nodes (node, n, f0) within the radius; most: rows of a task's side. A
    radius that leaves blocks of under 12 bits compares all, in a grid."""
    if 64 // (radius + 1) < 12:
        return on_grid(nodes.select(F.lit(0).alias("key"), "node", "n", "f0"), F.lit(nodes.count()), 1, radius, 0.0, most)
    return block_links(nodes, bit_blocks(nodes, radius), 1, radius, 0.0, most)


def few_rows(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """One column of ids, to be broadcast if there are at most `most`, some 50 MB; beyond that Spark joins it as any table."""
    return F.broadcast(ids) if len(ids.limit(most + 1).groupBy().count().where(F.col("count") <= most).head(1)) else ids


def shingle_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """node, digest and shingles (hashes, each once) of each node; docs: doc_id, text; nodes: node, least, digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for lo, hi, data, offs in chunks(batch.column(1)):
                    h, n = shingle_arrays(data, offs, k)
                    digest, some = np.zeros(hi - lo, np.uint64), n > 0
                    if some.any():
                        digest[some] = np.add.reduceat(mix64(h), (np.cumsum(n) - n)[some])
                    sets = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(h.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(digest.view(np.int64)), sets], ["doc_id", "digest", "shingles"])

    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    asked = nodes.select("node", F.col("least").alias("a_id"), F.col("digest").alias("a_digest"))
    wanted = few_rows(asked.select("a_id").distinct())  # so that the texts stay where they are read
    texts = ids.join(wanted, F.col("doc_id").eqNullSafe(F.col("a_id")), "left_semi")
    sets = texts.mapInArrow(run, "doc_id bigint, digest bigint, shingles array<bigint>").dropDuplicates(["doc_id", "digest"])
    return sets.join(asked, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("digest") == F.col("a_digest"))).select("node", "shingles")


def similar(docs: DataFrame, nodes: DataFrame, found: DataFrame, k: int, width: int, radius: int, ratio: float, most: int = MOST_SHINGLES) -> DataFrame:
    """Links (src, dst) that span the groups of exact similarity; nodes: node, least, n, digest, f0 ...; found: node, root of candidates."""
    asked = settle(nodes.join(found, "node"))
    per = settle(asked.groupBy("root").agg(F.sum("n").alias("size")))
    shares = F.lit(per.agg(F.coalesce(F.ceil(F.sum("size") / (most / 4)), F.lit(1))).first()[0])
    large = F.col("size") > most / 4
    key = F.struct(large.alias("large"), F.when(large, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), shares)).alias("at"))
    rows = asked.join(per, "root").join(shingle_sets(docs, asked, k), "node")
    rows = rows.select(key.alias("key"), F.when(large, F.col("size")).otherwise(1).alias("size"), "node", "n", *(f"f{i}" for i in range(width)), "shingles")
    return on_grid(rows, F.col("size"), width, radius, ratio, most)


def grouped(prints: DataFrame, nodes: DataFrame, found: DataFrame, same: list[str]) -> DataFrame:
    """prints with component_id. nodes: node, least (id), and the columns `same` that name it; found: node, root."""
    comp = nodes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = comp.groupBy("root").agg(F.min("least").alias("component_id"))
    named = comp.join(least, "root").select(*(F.col(w).alias(f"_{w}") for w in same), "component_id")
    on = F.lit(True)
    for w in same:
        on &= F.col(w) == F.col(f"_{w}")
    return prints.join(named, on, "left").drop(*(f"_{w}" for w in same))


def bit_duplicates(docs: DataFrame, k: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """One row for each row of docs: doc_id, f0, component_id (the smallest id reachable by links of at most radius bits)."""
    prints = settle(fingerprints(docs, k, seed))
    nodes = settle(prints.groupBy("f0").agg(F.min("doc_id").alias("least"), F.max("n").alias("n")).withColumn("node", F.col("f0")))
    return grouped(prints, nodes, components(links(nodes, radius)), ["f0"]).select("doc_id", "f0", "component_id")


def near_duplicates(docs: DataFrame, k: int = 5, ratio: float = 0.8, words: int = 4, radius: int = 72) -> DataFrame:
    """One row for each row of docs: doc_id, f0, f1 ..., component_id (the smallest id of its group).

    ratio: the least Jaccard similarity of the sets of k-word shingles of linked texts. At 0.8, 41 of the 256 bits
    differ on average, with a deviation of 6; the radius is the bound of candidates that goes with it.
    """
    width = [f"f{i}" for i in range(words)]
    same = ["n", "digest"]
    scratch = Scratch(docs.sparkSession)
    prints = scratch.keep(set_prints(docs, k, words, ratio).withColumn("node", F.xxhash64(*same)), "prints")
    nodes = settle(prints.groupBy("node", *same).agg(F.min("doc_id").alias("least"), *(F.first(w).alias(w) for w in width)))
    # a set of n shingles and another one are similar by n / (n + 1) at most
    apart = (F.col("n") > 0) & (F.col("n") >= ratio * (F.col("n") + 1) - 1e-9)
    found = components(block_links(nodes.where(apart), settle(shared_firsts(prints.where(apart).select("node", "firsts"))), words, radius, ratio, 60_000))
    found = components(similar(docs, nodes, found, k, words, radius, ratio))
    return grouped(prints.drop("firsts", "node"), nodes, found, same).select("doc_id", *width, "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bit_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
