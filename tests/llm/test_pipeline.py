"""The pipeline's stages against brute force on their own inputs, and odd tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(t):
    w = (t or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.fixture(scope="module")
def docs(spark):
    """The smallest documents, with copies near and exact, junk without letters, nulls and personal data."""
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*cp.COLUMNS).collect()]
    rng = random.Random(5)
    own = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)) for _ in range(6)]
    rows += [(5000 + i, t, "en", "new", len(t)) for i, t in enumerate(own)]
    for i in range(4):
        w = own[i].split()
        w[rng.randrange(20, 280)] = "changed"
        rows += [(6000 + i, " ".join(w), "en", "new", 1), (7000 + i, own[i], "en", "other", 1)]
    rows += [(8000, None, "en", None, None), (8001, "", None, None, 0), (8002, "1234 !!", "en", "new", 7), (None, own[5] + " end of it", None, None, 5), (8004, own[4] + " write to ann.lee@example.com now", "en", "new", 5), (8004, own[4], "en", "new", 5)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def stages(spark, docs, tmp_path_factory):
    out, d = [docs], docs
    for i, (_, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("pipeline") / str(i))
        stage(spark, d, SF).write.parquet(path)
        d = spark.read.parquet(path)
        out.append(d)
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns_and_order(stages):
    assert [n for n, _ in cp.STAGES] == ["language identification", "near-duplicates", "benchmark decontamination", "personal data", "mixing"]
    assert all(d.columns == cp.COLUMNS for d in stages[1:5]) and set(cp.COLUMNS) < set(stages[5].columns)


def test_language_stage(stages):
    gone = {i for i, t in texts(stages[0])} - {i for i, t in texts(stages[1])}
    assert {8000, 8001, 8002} <= gone and all(not any(c.isalpha() for c in t or "") for i, t in texts(stages[0]) if i in gone)
    assert stages[1].where("lang is null").count() == 0


def test_near_duplicate_stage(stages):
    before, kept = texts(stages[1]), texts(stages[2])
    ids = [i for i, _ in kept]
    assert len(ids) == len(set(ids)) and None not in ids  # its text resembles that of 5005
    s = {i: shingles(t) for i, t in kept if i is not None}
    for a in s:
        for b in s:
            if a < b:
                assert len(s[a] & s[b]) / len(s[a] | s[b]) < 0.8, (a, b)
    all_ = {k: shingles(t) for k, (_, t) in enumerate(before)}
    for i, (k, t) in enumerate(before):  # what is gone resembles another text
        if k not in ids:
            x = shingles(t)
            assert max(len(x & y) / len(x | y) for j, y in all_.items() if j != i) >= 0.8, i
    assert not {6000, 6001, 6002, 6003, 7000, 7001, 7002, 7003} & set(ids)


def test_near_duplicates_are_checked_exactly(spark):
    """Pairs at similarity 0.6 and 0.7 stay apart, pairs at 0.8 are found, short ones too; chains only through real links."""
    rng, rows, want = random.Random(9), [], {}
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(8))
    for a, more in ((8, 1), (12, 2), (165, 40)):  # a words, of which the longer text has `more` more
        for _ in range(60):
            w = [word() for _ in range(a + more)]
            rows += [(len(rows), " ".join(w[:a])), (len(rows) + 1, " ".join(w))]
    for cut in (15, 30):  # texts that differ in a block of words
        for _ in range(30):
            w = [word() for _ in range(165)]
            rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w[:60] + [word() for _ in range(cut)] + w[60 + cut :]))]
    s = [shingles(t) for _, t in rows]
    for i in range(0, len(rows), 2):
        near = 10 * len(s[i] & s[i + 1]) >= 8 * len(s[i] | s[i + 1])
        want |= {i: i, i + 1: i if near else i + 1}
    assert 0 < sum(i != k for i, k in want.items()) < len(rows) / 2
    got = {r["doc_id"]: r["component_id"] for r in cp.simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


@pytest.mark.parametrize("most", [4_000_000, 2000])
def test_similar_groups_in_stripes(spark, most):
    """A group of candidates dealt to stripes has the links of all pairs."""
    sim, rng = cp.simhash, random.Random(4)
    w = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(100)]
    rows = [(i, " ".join(w[: 100 - k] + [f"x{i}y{j}" for j in range(k)])) for i, k in enumerate([0, 4, 5, 6, 12, 18, 19, 20, 30, 40] * 4)]
    s = {i: shingles(t) for i, t in rows}
    want = {i: i for i in s}
    for _ in s:
        for a in s:
            for b in s:
                if 10 * len(s[a] & s[b]) >= 8 * len(s[a] | s[b]):
                    want[b] = min(want[a], want[b])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = sim.set_prints(docs, 5, 4, 0.8).groupBy("n", "digest", "f0", "f1", "f2", "f3").agg(F.min("doc_id").alias("node")).withColumn("least", F.col("node"))
    links = sim.similar(docs, nodes, nodes.select("node", F.lit(0).cast("long").alias("root")), 5, 4, 256, 0.8, most)
    got = {r["node"]: r["root"] for r in sim.components(links).collect()}
    assert {i: got.get(i, i) for i in s if s[i] != s[0] or i == 0} == {i: k for i, k in want.items() if s[i] != s[0] or i == 0}


def test_firsts_lose_no_pair(spark):
    """Every pair of sets at the ratio or above shares a block, also where a passage stands in most texts."""
    rng = random.Random(3)
    common = " ".join(f"c{i}" for i in range(30))
    rows = []
    for i in range(60):
        w = [f"w{rng.randrange(10**9)}" for _ in range(rng.choice([5, 6, 9, 40, 120]))]
        for k in range(4):
            v = list(w)
            for _ in range(rng.randrange(1 + len(w) // 30)):
                v[rng.randrange(len(v))] = f"y{rng.randrange(10**9)}"
            rows.append((4 * i + k, " ".join(v + [f"z{j}" for j in range(rng.randrange(3))]) + (" " + common if i % 2 else "")))
    s = {i: shingles(t) for i, t in rows}
    want = {(a, b) for a in s for b in s if a < b and 10 * len(s[a] & s[b]) >= 8 * len(s[a] | s[b]) and s[a] != s[b]}
    prints = cp.simhash.set_prints(spark.createDataFrame(rows, "doc_id long, text string"), 5, 4, 0.8)
    firsts = {r["doc_id"]: set(r["firsts"]) for r in prints.collect()}
    assert len(want) > 50 and all(firsts[a] & firsts[b] for a, b in want)
    blocks = cp.simhash.shared_firsts(prints.select(F.col("doc_id").alias("node"), "firsts")).collect()
    by = {}
    for r in blocks:
        by.setdefault(r["key"]["v"], set()).add(r["node"])
    assert all(any({a, b} <= nodes for nodes in by.values()) for a, b in want)


def test_decontamination_stage(spark, stages):
    items = [t for _, t in texts(spark.read.parquet(f"{SF}/benchmark.parquet").withColumnRenamed("item_id", "doc_id"))]
    whole = [" ".join(t.split()) for t in items]
    after = {i for i, _ in texts(stages[3])}
    leaks = {i for i, t in texts(stages[2]) if any(w in " ".join(t.split()) for w in whole)}
    assert not leaks & after and len({i for i, _ in texts(stages[2])} - after - leaks) <= 2


def test_personal_data_stage(stages):
    before, after = dict(texts(stages[3])), dict(texts(stages[4]))
    assert before.keys() == after.keys()
    assert not stages[4].where(F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]")).count()
    assert all(before[i] == after[i] or "[" in after[i] for i in before)
    assert stages[4].where(F.col("text").contains("[EMAIL]") & (F.col("n_chars") != F.length("text"))).count() == 0


def test_mixing_stage(stages):
    rows = stages[5].collect()
    assert len(rows) == stages[4].count() and all(r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] for r in rows)
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)


def test_null_and_repeated_ids_are_rows(spark, stages):
    """Copies without an id are one, leaks without an id go, other texts of one id stay, and mixing multiplies nothing."""
    own = [t for i, t in texts(stages[0]) if i is not None and 5000 <= i < 5006]
    leak = max((t for _, t in texts(spark.read.parquet(f"{SF}/benchmark.parquet").withColumnRenamed("item_id", "doc_id"))), key=len)
    rows = [(None, own[0], "en", "a", 1), (None, own[0], "en", "a", 1), (None, own[1], "en", "a", 1), (None, own[2] + " " + leak, "en", "a", 1), (7, own[3], "en", "a", 1), (7, own[4], "en", "a", 1), (8, own[4], "en", "a", 1)]
    dedup = cp.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), SF)
    key = lambda r: str(tuple(r))
    assert sorted(map(key, texts(dedup))) == sorted(map(key, [(r[0], r[1]) for r in rows[1:6]]))
    clean = cp.decontamination(spark, spark.createDataFrame(rows, SCHEMA), SF)
    assert sorted(map(key, texts(clean))) == sorted(map(key, [(r[0], r[1]) for r in rows if leak not in r[1]]))
    mixed = cp.mixture(spark, spark.createDataFrame(rows, SCHEMA), SF)
    assert sorted(map(key, texts(mixed))) == sorted(map(key, [(r[0], r[1]) for r in rows]))


def test_empty_table(spark, docs):
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
