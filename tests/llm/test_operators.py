"""Each operator against a brute-force version on small tables, and on awkward ones."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siltflow.llm import decontaminate, katz, langid, mixing, pii, quality, registry, simhash, suffixdedup, toxicity, urlfilter

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(name):
    return duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def docs():
    return table("documents")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, wordless and long texts, repeated rows and ids, and columns whose names clash with results."""
    long = " ".join(f"word{i % 977} tail" for i in range(60_000))
    rows = [
        (1, None, "en", "a", 0), (2, "", None, None, None), (3, " \n\t", "en", "a", 3), (4, "the same words here", "en", "b", 1), (4, "the same words here", "en", "b", 1), (5, "the same words here", "de", None, 1),
        (None, "the same words here", "en", "b", 1), (None, None, None, None, None), (6, long, "en", "a", 9), (7, "x", "fr", "c", 1), (8, "é" * 500, "fr", "c", 1), (9, "a" * 3000, "fr", "c", 1), (10, "1234 5678 ... !!", "en", "c", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    clash = ("size", "target", "copies", "score", "lang_pred", "id", "h", "n", "f0", "node", "uid", "spans", "held", "kept", "n_words", "toxic", "pos", "contaminated", "rate", "root")
    return df.withColumns({c: F.lit("clash") for c in clash})


def fold(i, k=5):
    return zlib.crc32(("" if i is None else str(i)).encode()) % k


OPS = {
    "op1": lambda d: suffixdedup.deduplicate(d),
    "op3": lambda d: langid.identify(d),
    "op4": lambda d: katz.score(d.withColumn("held", F.lit(False))),
    "op5": lambda d: simhash.bit_duplicates(d),
    "op5wide": lambda d: simhash.near_duplicates(d),
    "op6": lambda d: pii.find(d),
    "op7": lambda d: toxicity.detect(d, d.select("doc_id", F.col("n_chars").alias("toxic"))),
    "op8": lambda d: quality.judge(d, d.select("doc_id", F.col("n_chars").alias("quality"))),
    "op9": lambda d: decontaminate.verdicts(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    "op10": lambda d: mixing.mix(d),
}


@pytest.mark.parametrize("name", OPS)
def test_odd_and_empty_tables(spark, odd, name):
    rows = OPS[name](odd).collect()
    assert len(rows) == odd.count() and Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd.select("doc_id").collect())
    assert OPS[name](odd.limit(0)).count() == 0
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert len({tuple(map(str, r)) for r in by[4]}) == 1 or name in ("op10",)
    if name == "op3":
        assert by[1][0]["lang_pred"] == by[2][0]["lang_pred"] == by[10][0]["lang_pred"] == "und" and by[7][0]["lang_pred"] != "und"
    if name == "op5":
        assert {r["component_id"] for r in by[4] + by[5]} == {4} and by[1][0]["component_id"] == by[2][0]["component_id"] == by[3][0]["component_id"] == 1
    if name == "op10":
        assert by[1][0]["size"] == 0 and all(r["taken"] <= 2 * r["size"] for r in rows)


def check_spans(got, texts):
    count = Counter(t[k : k + 200] for _, t in texts for k in range(len(t) - 199))
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - 199):
            if count[t[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        assert got[i] == (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()), i


@pytest.mark.parametrize("hot", [100_000, 1])
def test_suffix_dedup(spark, docs, hot):
    rng = np.random.default_rng(3)
    texts = [(r[0], (r[1] or "")) for r in docs[:120]]
    phrase = "".join(rng.choice(list("abcdef "), 260))
    for n, k in enumerate((199, 200, 201, 260)):
        texts += [(9000 + 2 * n, phrase[:k]), (9001 + 2 * n, "q" * n + phrase[260 - k :] + "z" * 50)]
    texts += [(9100, "ab" * 400), (9101, "aab" * 100), (9102, "".join(rng.choice(list("ab"), 3000))), (9103, "é" * 150), (9104, phrase[:230] + "!" + phrase[1:231]), (9105, "x" * 200), (9106, "x" * 199)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffixdedup.deduplicate(df, hot=hot).collect()}
    check_spans(got, [(i, t.encode()) for i, t in texts])


def test_minimizers_are_the_same_in_texts_of_any_length():
    """Strings of 200 bytes have the same minimizers in a chunk of their own and in one of 12 MB."""
    rng = np.random.default_rng(11)
    few = rng.integers(97, 123, (2000, 200), dtype=np.uint8)
    long = rng.integers(97, 123, 12_000_000, dtype=np.uint8)
    at = np.arange(2000) * 5000 + 100
    for a, x in zip(at, few):
        long[a : a + 200] = x
    own = [suffixdedup.cut_pieces(x, np.array([0, 200]), 200) for x in few]
    _, start, n, least, mz = suffixdedup.cut_pieces(long, np.array([0, len(long)]), 200)
    of = np.searchsorted(start, at, "right") - 1
    assert [int(o[3][0]) for o in own] == list(least[of] - at) and [int(o[4][0]) for o in own] == list(map(int, mz[of]))


def test_suffix_dedup_of_rows_without_ids(spark):
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdef "), n))
    phrase = word(230)
    texts = [word(300) + phrase + word(50), word(10) + phrase[5:225] + word(500), word(900), "x" * 150]
    rows = [(None, t) for t in texts] + [(None, texts[2]), (5, word(240)), (5, phrase[:210] + word(99)), (None, None), (None, "")]
    got = suffixdedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    named = [(i, (t or "").encode()) for i, (_, t) in enumerate(rows)]
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["n_bytes"], []).append(tuple(r)[1:5])
    check_spans({i: by[len(t)].pop() for i, t in named}, named)


def test_pieces_are_judged_alike_in_any_batches():
    """One minimizer that fills many buffers, in batches of all sizes, is told as in one piece, but for being split."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    rows = sorted((int(m), int(p), 0, 0, i, 1, int(rng.random() < 0.1) + 1, 0) for i, (m, p) in enumerate(zip(rng.choice([1, 2, 2, 2, 2, 3], 300), rng.integers(0, 90, 300))))
    whole = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i < 4 else pa.int32()) for i in range(8)], [x.split()[0] for x in suffixdedup.PIECE.split(", ")])
    told = lambda size, most: [tuple(r.values()) for b in suffixdedup.judge_sorted(iter(whole.slice(i, size) for i in range(0, 300, size)), 1000, most) for r in b.to_pylist()]
    want = {(r[0], r[4]): (r[8], r[9]) for r in told(300, 10_000)}
    for size, most in ((1, 2), (3, 10), (7, 50), (300, 20)):
        got = {(r[0], r[4]): (r[8], r[9]) for r in told(size, most)}
        assert got == want


def test_language_id_held_out(spark):
    rows = registry.QUERIES["op3_language_id"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    lang = dict(duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) >= 0.97 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_filter_members_and_correction():
    lang, gram = np.array(["a", "b", "a", "c"], object), np.array([1, 1, 2, 3])
    f = langid.Filter.build(lang, gram)
    bits = f.members(np.array([1, 2, 3])).ravel()
    assert [int(b) & 7 for b in bits] == [3, 1, 4]
    best, score = f.decide(np.array([1, 2, 1, 3]), np.array([0, 0, 0, 1]), 3)
    assert list(best) == [0, 2, -1] and score[0] > 0.99 and score[2] == 0


def good_turing(counts, k=5):
    """Katz's discounts from a least-squares line through log N(c) over log c, c = 1 ... k + 1."""
    of = Counter(counts.values())
    points = [(math.log(c), math.log(of[c])) for c in range(1, k + 2) if of[c]]
    slope = float(np.polyfit(*zip(*points), 1)[0]) if len(points) > 1 else -2.0
    n = {c: math.exp(min(slope, -1.05) * math.log(c)) for c in range(1, k + 2)}
    a = (k + 1) * n[k + 1] / n[1]
    return [1.0] + [((c + 1) * n[c + 1] / n[c] / c - a) / (1 - a) for c in range(1, k + 1)]


@pytest.mark.parametrize("histogram", [[0, 9, 4, 2, 1, 1, 1], [0, 5, 5, 5, 5, 5, 5], [0, 1, 2, 3, 4, 5, 60], [0, 0, 7, 0, 0, 0, 0], [0] * 7, [0, 47282, 12115, 4986, 2403, 2211, 1010]])
def test_good_turing_always_holds(histogram):
    d = katz.discounts(np.array(histogram))[1:]
    assert (d > 0).all() and (d < 1).all() and (np.diff(d) > 0).all()


def test_katz_held_out_gain(spark):
    """Texts that the model hasn't seen are likelier under it than under the base, by over half a decade a token."""
    rows = registry.QUERIES["op4_katz"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    n = sum(r["n_tokens"] for r in rows)
    assert (sum(r["score"] for r in rows) - sum(r["base_score"] for r in rows)) / n > 0.5
    assert np.mean([r["score"] > r["base_score"] for r in rows]) > 0.85


def test_language_filter_against_brute_force(spark, docs):
    """Sets of n-grams in dictionaries give the same languages; the cluster's filter is that of the arrays."""
    rows = [(r[0], r[1], r[2]) for r in docs] + [(9001, "\u6f22\u5b57\u6f22\u5b57 \u6f22\u5b57", None), (9002, "\u03c9\u03c8", None)]
    train = [(t, lang) for i, t, lang in rows if fold(i) and t and lang]
    counts = defaultdict(Counter)

    def grams(t):
        core = " ".join("".join(c if c.isalpha() else " " for c in (t or "").lower()).split())
        data = f"  {core}  ".encode() if core else b""
        return [int.from_bytes(data[k : k + 4], "big") for k in range(len(data) - 3)]

    for t, lang in train:
        counts[lang].update(grams(t))
    kept = {}
    for lang, c in counts.items():
        total, done = sum(c.values()), 0
        for n in sorted(set(c.values()), reverse=True):
            if done >= 0.99 * total:
                break
            least, done = n, done + n * sum(1 for x in c.values() if x == n)
        kept[lang] = {g for g, n in c.items() if n >= least}
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, t, _ in rows:
        g = grams(t)
        share = {lang: sum(x in k for x in g) / max(1, len(g)) for lang, k in kept.items()}
        best = max(sorted(share), key=share.get)
        r = got[i]
        if not g:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
        else:  # false positives of the filter may move a count by a few
            assert r["score"] == pytest.approx(share[best], abs=0.02) and share[r["lang_pred"]] >= share[best] - 0.02
    assert got[9001]["lang_pred"] == min(kept)
    pairs = [(lang, g) for lang in kept for g in sorted(kept[lang])]
    whole = langid.Filter.build(np.array([x for x, _ in pairs], object), np.array([g for _, g in pairs]))
    model = langid.train(spark.createDataFrame([(t, lang) for t, lang in train], "text string, lang string"))
    assert model.languages == whole.languages and (model.slots == whole.slots).all()


def katz_brute(rows):
    """rows: id, held, text. Scores by dictionaries."""
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    toks = {i: (held, [*WORD.findall(lower(t)), None]) for i, held, t in rows}
    uni, bi, hist = Counter(), Counter(), Counter()
    for held, ts in toks.values():
        if not held:
            uni.update(ts)
            for v, w in zip(["<s>", *ts], ts):
                bi[v, w] += 1
                hist[v] += 1
    n, types = sum(uni.values()), len(uni)
    d1, d2 = good_turing(uni), good_turing(bi)
    spare = 0 if any(uni[w] * (1 - d1[uni[w]]) > 0 for w in uni if uni[w] <= katz.K) else 1
    disc = lambda d, c: d[c] * c if c <= katz.K else c
    unseen = (n + spare - sum(disc(d1, c) for c in uni.values())) / (n + spare)
    p1 = lambda w: disc(d1, uni[w]) / (n + spare) if uni[w] else unseen / max(types, 2)
    after = defaultdict(list)
    for (v, w), c in bi.items():
        after[v].append((w, c))
    back, whole = {}, {}
    for v, ws in after.items():
        kept = sum(disc(d2, c) for _, c in ws)
        whole[v] = hist[v] + (kept > hist[v] - 1e-9)
        back[v] = (1 - kept / whole[v]) / (1 - sum(p1(w) for w, _ in ws))
        seen = {w for w, _ in ws}
        total = sum(disc(d2, c) / whole[v] for _, c in ws) + back[v] * (sum(p1(w) for w in uni if w not in seen) + unseen)
        assert abs(total - 1) < 1e-9  # exactly normalised
    p = lambda v, w: disc(d2, bi[v, w]) / whole[v] if bi[v, w] else back.get(v, 1.0) * p1(w)
    return {
        i: (len(ts), sum(uni[w] > 0 for w in ts), n, sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (types + 1))) for w in ts), sum(math.log10(p(v, w)) for v, w in zip(["<s>", *ts], ts)))
        for i, (held, ts) in toks.items()
    }


@pytest.mark.parametrize("hot_share", [0.001, 0.5])
def test_katz(spark, docs, hot_share):
    rows = [(r[0], fold(r[0]) == 1, r[1]) for r in docs[:60]] + [(-1, False, None), (-2, True, "Never SEEN words")]
    want = katz_brute(rows)
    got = katz.score(spark.createDataFrame(rows, "doc_id long, held boolean, text string"), hot_share).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[r["doc_id"]][:3]
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][3], rel=1e-9) and r["score"] == pytest.approx(want[r["doc_id"]][4], rel=1e-9)


def print_of(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def closure(near):
    lab = np.arange(len(near))
    while True:
        new = np.where(near, lab[None, :], len(lab)).min(1)
        if (new == lab).all():
            return lab
        lab = new


def test_simhash(spark, docs):
    f = np.array([print_of(r[1]) for r in docs], np.uint64)
    ids = np.array([r[0] for r in docs])
    order = np.argsort(ids)
    lab = closure(np.bitwise_count(f[order][:, None] ^ f[order][None]) <= 2)
    want = {int(ids[order][i]): (f"{f[order][i]:016x}", int(ids[order][lab[i]])) for i in range(len(ids))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in registry.QUERIES["op5_simhash"](spark, SF).collect()} == want


def test_rows_without_ids_link(spark):
    """A chain of distances of 2 bits through a row without an id is one component; it gets the smallest id."""
    rng, found = np.random.default_rng(7), {}
    while len(found) < 3:  # texts of one shingle each have its hash as their fingerprint; 3-word texts near each other are searched
        base = [f"w{rng.integers(1 << 40)}" for _ in range(40)]
        texts = [" ".join(base[:i] + [f"x{rng.integers(1 << 40)}"] + base[i + 1 :]) for i in (0, 39)]
        a, b, c = print_of(" ".join(base)), *map(print_of, texts)
        if bin(a ^ b).count("1") <= 2 and bin(a ^ c).count("1") <= 2 < bin(b ^ c).count("1"):
            found = {1: texts[0], None: " ".join(base), 3: texts[1]}
    rows = [*found.items(), (None, "alone here"), (None, None), (8, "alone here too now")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.bit_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 1), (None, 1), (3, 1), (None, None), (None, None), (8, 8)], key=str)


@pytest.mark.parametrize("radius, most", [(2, 60_000), (2, 20), (10, 50)])
def test_links_are_exact(spark, radius, most):
    """Blocks, hot block values and the grid give the components of all pairs."""
    rng = np.random.default_rng(1)
    f = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for i in range(40, 200):
        f[i] = f[i - 40] ^ (np.uint64(1) << np.uint64(rng.integers(64))) ^ (np.uint64(1) << np.uint64(rng.integers(64)))
    f[200:260] = (f[7] & np.uint64((1 << 43) - 1)) | (rng.integers(0, 1 << 20, 60, dtype=np.uint64) << np.uint64(43))
    f = np.unique(f)
    nodes = spark.createDataFrame([(i, 1, int(np.int64(x.astype(np.int64)))) for i, x in enumerate(f)], "node long, n long, f0 long")
    links = simhash.links(nodes, radius, most)
    from siltflow.llm.components import components

    got = {r["node"]: r["root"] for r in components(links).collect()}
    lab = closure(np.bitwise_count(f[:, None] ^ f[None]) <= radius)
    assert [got.get(i, i) for i in range(len(f))] == list(lab)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


TRICKY = [
    "a@b.c_d@e.f x@y", "é a.b@c-d.example.com, (me@x.org)", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.255 1.2.3.0000256", "4111 1111 1111 1111 4111-1111-1111-1111-", "41111111111111111111 5 4111111111111111",
    "0000000000000000 1 2 3", "+1 (132) 555-1234 +12 +1234567 +49 30 1234567890123456 ++12345678", "12 34-56  7", "@", "a@b", "." * 50, "9" * 5000, "x" * 5000 + "@y.z", "a@" + "b." * 3000 + "c", "7-" * 4000,
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and password: "hunter2hunter"', "mail me at jo (at) example (dot) com", "ssn 123-45-6789, call 555-123-4567", None, "",
]


def test_pii_base_spans(spark, docs):
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(r[0] + 1000, r[1]) for r in docs]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", *pii.KINDS, pii.digest(F.col("spans")).alias("d")).collect()
    texts = dict(rows)
    for r in found:
        want = base_spans(texts[r["doc_id"]])
        assert [(k, s["start"], s["end"]) for k in pii.KINDS for s in r[k]] == want, texts[r["doc_id"]]
        assert {":".join(map(str, w)) for w in want} <= set(r["d"].split(",") if r["d"] else [])


def test_pii_adds_and_redacts(spark):
    rows = [(i, f'x token = "{hashlib.sha1(str(i).encode()).hexdigest()}" é jo{i}@example.com.') for i in range(50)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"))
    for r in found.select("doc_id", pii.digest(F.col("spans")).alias("d"), pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect():
        assert r["d"].count("secret:") == 1 and r["t"] == "x [SECRET] é [EMAIL]."


def iban(country, digits):
    whole = "".join(str(int(c, 36)) for c in digits + country + "00")
    return f"{country}{98 - int(whole) % 97:02d}{digits}"


def test_pii_classifier_accepts_and_rejects(spark):
    """Of loose candidates of each kind, those that most labelers speak for are added, the others aren't."""
    rng = np.random.default_rng(8)
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    rows, want = [], []
    for i in range(150):
        h = hashlib.sha1(str(i).encode()).hexdigest()
        area = f"{rng.integers(2, 9)}{num(2)}"
        good = {"phone": f"call me at {area}-{rng.integers(2, 10)}{num(2)}-{num(4)} today", "ssn": f"social security number {rng.integers(100, 600)}-{rng.integers(10, 99)}-{rng.integers(1000, 9999)}.", "iban": f"account iban {iban('DE', num(18))} please", "secret": f'token = "{h}"', "email": f"write to ann{i} (at) mail{i} (dot) com now"}
        bad = {"phone": f"order number {rng.choice(['000', '111', '123'])}-{num(3)}-{num(4)}.{num(2)}", "ssn": f"part no 000-{num(2)}-0000", "iban": f"serial XY00 {num(4)} {num(4)} {num(4)} {num(4)}", "secret": 'sample password: "xxxxxxxx"', "email": f"test a{i} at the{i} dot example"}
        for truth, texts in ((True, good), (False, bad)):
            for k, t in texts.items():
                rows.append((len(rows), f"é some words here, {t} and others there"))
                want.append((k, truth))
    got = {r["doc_id"]: r["d"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.digest(F.col("spans")).alias("d")).collect()}
    for kind in ("phone", "ssn", "iban", "secret", "email"):
        told = {t: np.mean([f"{kind}:" in got[i] for i, (k, x) in enumerate(want) if k == kind and x == t]) for t in (True, False)}
        assert told[True] >= 0.9 and told[False] <= 0.1, (kind, told)


def test_pii_gazetteer_table(spark):
    """A table of terms replaces the built-in one; a term that it speaks against is voted on so."""
    table_ = spark.createDataFrame([("email", "zz", -1), ("email", "com", 1), (None, "x", 1)], "kind string, term string, vote int")
    c = spark.sql("SELECT named_struct('kind', 'email', 'start', 0, 'end', 5, 'found', found, 'base', false, 'before', '', 'after', '') AS c FROM VALUES ('a at b dot zz'), ('a at b dot com'), ('a at b dot de') AS t(found)")
    assert [r[0] for r in c.select(pii.voted(F.col("c"), pii.gazetteer_terms(table_))["gazetteer"]).collect()] == [-1, 1, 0]
    with pytest.raises(ValueError):
        pii.gazetteer_terms(spark.range(pii.MOST_GAZETTEER + 1).select(F.lit("email").alias("kind"), F.col("id").cast("string").alias("term"), F.lit(1).alias("vote")))


def test_em_finds_reliable_labelers():
    """Two labelers agree with the truth nine times in ten, one is noise: the posterior follows the two."""
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    votes = [np.where(rng.random(4000) < a, truth, ~truth) * 2 - 1 for a in (0.9, 0.9, 0.5)]
    count = Counter(zip(*(map(int, v) for v in votes)))
    post = pii.reliabilities([("k", v, n) for v, n in count.items()])
    assert post["k", (1, 1, -1)] > 0.9 and post["k", (-1, -1, 1)] < 0.1
    assert abs(post["k", (1, 1, 1)] - post["k", (1, 1, -1)]) < 0.1


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in registry.QUERIES["op7_toxicity"](spark, sf).where("held_out").collect()}
    labels = [x for x in duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall() if x[0] in got]
    bad, good = ([got[i]["score"] for i, t in labels if t == k] for k in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good])
    assert auc > 0.93 and np.mean([s >= 0.5 for s in good]) < 0.02


def test_toxicity_folding():
    lex = toxicity.Lexicon({" stupid ": 3.0, " scum ": 2.0, " achlich": 2.5}, curve=(-2.0, 1.0, 0.0))
    hit = lambda t: lex.found(t)[0]
    assert hit("So STUP1D!") == hit("ѕtuріd") == hit("stupid$$$") == 3.0 and hit("stupidity") == 0
    assert hit("pond scum floats") == 0 and hit("scum") == 2.0 and hit("achlichkeit und achlich") == 5.0
    assert lex.score(None) == lex.score("") and lex.score("stupid scum") > 0.5


def test_toxicity_learns_terms_and_exceptions(spark):
    """No term is cut off, stems that say no more than a shorter one are left out, and harmless pairs are learned."""
    rng = np.random.default_rng(6)
    rude = [f"rude{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    plain = [f"plain{i}" for i in range(50)]
    word = lambda: "".join(rng.choice(list("etaoin"), 5))
    rows = [(f"{word()} {rude[i % 300]} {word()} grubbywort {word()}", 1) for i in range(3000)]
    rows += [(f"{word()} {rng.choice(plain)} {word()} the grubbywort plant", 0) for _ in range(400)] + [(" ".join(word() for _ in range(6)), 0) for _ in range(3000)]
    lex = toxicity.learn(spark.createDataFrame(rows, "text string, toxic int"))
    begins = lambda w: any(f" {w} "[: len(t)] == t for t in lex.weights)
    assert all(begins(w) for w in rude) and begins("grubbywort") and not any(t != " grubb" and t.startswith(" grubb") for t in lex.weights)
    assert "grubbywort plant" in lex.exceptions and "the grubbywort" in lex.exceptions
    assert lex.found("see the grubbywort plant")[0] == 0 < lex.found("you grubbywort")[0]
    with pytest.raises(ValueError):
        toxicity.bounded(spark.range(5), 4)


def stats_brute(t):
    w = WORD.findall(t or "")
    count = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), dup, len(covered)


def test_quality_statistics(spark, docs):
    rows = [(r[0], r[1]) for r in docs] + [(-i - 1, t) for i, t in enumerate([None, "", "a\n\na\n a\n", "a b c d e f g h " * 5, "ü\nü\nü\n", "\n", "x"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[1]) for r in table("labels")], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.judge(df, labels).collect()}
    for i, t in rows:
        want = stats_brute(t)
        assert tuple(got[i][c] for c in quality.COUNTS[:5]) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert got[i]["base_failed"] == failed and not (failed and got[i]["kept"])


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    kept = {r["doc_id"]: r["kept"] for r in registry.QUERIES["op8_quality_rules"](spark, sf).collect()}
    labels = [x for x in duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall() if fold(x[0]) == 0]
    assert np.mean([kept[i] for i, q in labels if q == 1]) > 0.94 and np.mean([kept[i] for i, q in labels if q == 0]) < 0.05


def test_quality_verdicts_in_any_partitioning(spark):
    """The forest depends on the rows alone, and a row that is repeated ten thousand times is drawn once."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    many = docs.select("doc_id", "text").unionByName(spark.range(10_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("the same text").alias("text")))
    got = [sorted(map(str, quality.judge(d, labels, trees=20).collect())) for d in (many, many.repartition(7))]
    assert got[0] == got[1]


def test_forest_isolates():
    x = np.r_[np.random.default_rng(0).normal(size=(2000, 3)), [[9, 9, 9], [-9, 0, 8]]]
    score = quality.Forest(x, 100, 256, 1).score(x)
    assert set(np.argsort(score)[-2:]) == {2000, 2001} and quality.cutoff([(1, 50, 0), (5, 49, 1), (9, 1, 30)], 0.02) == 9 and quality.cutoff([(1, 5, 0)], 0.1) == 2001


def test_decontamination(spark, docs):
    items = table("benchmark")
    tok = lambda t: re.findall(r"[^\W_]+", t.lower())
    grams = defaultdict(set)
    for i, t in items:
        for k in range(len(tok(t)) - 7):
            grams[tuple(tok(t)[k : k + 8])].add((i, k))
    size = {i: max(1, len(tok(t)) - 7) for i, t in items}
    want = set()
    for r in docs:
        hits, w = defaultdict(set), tok(r[1])
        for k in range(len(w) - 7):
            for i, p in grams.get(tuple(w[k : k + 8]), ()):
                hits[i].add(p)
        if any(len(p) >= 6 or 2 * len(p) >= size[i] for i, p in hits.items()):
            want.add(r[0])
    got = {r["doc_id"] for r in registry.QUERIES["op9_decontamination"](spark, SF).where("contaminated").collect()}
    assert got == want and want


def test_decontamination_of_parameters(spark):
    item = "A farmer named Smith sells 12 baskets of apples for 3 dollars each and then buys 12 more baskets. How much did Smith earn in 5 hours?"
    same = "A farmer named Jones sells 40 baskets of apples for 7 euros each and then buys 40 more baskets. How much did Jones earn in 9 days?"
    mixed = "A farmer named Jones sells 40 baskets of apples for 7 euros each and then buys 41 more baskets. How much did Baker earn in 9 days?"
    rows = [(1, "Intro text. " + item + " End."), (2, same), (3, "An unrelated text about a farmer who sells apples and baskets in many places for years."), (4, item.upper()), (5, None), (6, " No!"), (7, item.lower())]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame([(7, item), (8, "Name the largest planet"), (9, None), (10, "no")], "item_id long, text string")
    got = {r["doc_id"]: r["items"] for r in decontaminate.verdicts(d, b).collect()}
    assert got == {1: [7], 2: [7], 3: [], 4: [7], 5: [], 6: [10], 7: [7]}
    full = decontaminate.contaminated(spark.createDataFrame([(1, same), (2, mixed)], "doc_id long, text string"), b, run=99).collect()
    n = {r["doc_id"]: r["n_windows"] for r in full}
    assert n[1] > n.get(2, 0)
    short = spark.createDataFrame([(1, "So: name the largest planet, please"), (2, "the largest planet")], "doc_id long, text string")
    assert {r["doc_id"]: r["items"] for r in decontaminate.verdicts(short, b).collect()} == {1: [8], 2: []}


def leaks(spark, item, *texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    return [bool(r["items"]) for r in sorted(decontaminate.verdicts(d, b).collect(), key=lambda r: r["doc_id"])]


def test_decontamination_of_names_that_begin_sentences(spark):
    item = "Tom has 5 apples. Tom gives 2 apples to Ann. How many apples does Tom have?"
    other = "Sue has 9 apples. Sue gives 4 apples to Bob. How many apples does Sue have?"
    mixed = "Sue has 9 apples. Eve gives 4 apples to Bob. How many apples does Kim have?"
    assert leaks(spark, item, item, other, "The Hague is far. The road is long. " + item, "The apples of Tom are red. How many does Ann eat?", mixed)[:4] == [True, True, True, False]


def test_decontamination_of_items_of_few_words(spark):
    item = "Add 12, 15, 18 and 21 then divide by 3"
    assert leaks(spark, item, "Now: " + item, "Add 7, 5, 9 and 4 then divide by 2", "Lines 12, 15, 18 and 21 are long") == [True, True, False]
    item = "12, 15, 18, 21, 24, 27, 30, 33, 36, what next?"
    assert leaks(spark, item, "So " + item, "13, 17, 19, 22, 25, 28, 31, 34, 37 were sold") == [True, False]


def test_decontamination_decides_on_texts(spark):
    """Rows without an id, and of one id, have the verdict of their own text; letters of other scripts are folded too."""
    item = "Анна купила 12 яблок и ещё 7 груш у соседа из города Тула вчера"
    rows = [(None, item), (None, "clean text of some words here and there"), (3, "so: " + item.upper()), (3, "other text, as clean as it gets to be"), (4, item.replace("12", "30").replace("7", "5"))]
    got = decontaminate.verdicts(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["contaminated"]) for r in got) == [("3", False), ("3", True), ("4", True), ("None", False), ("None", True)]


def test_key_table(spark):
    """A table that is too small for its keys drops none of them."""
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 63), 1 << 63, 5000)
    t = decontaminate.key_table(spark.createDataFrame([(int(k),) for k in keys], "key long"), 5000)
    assert decontaminate.all_set(t, keys.view(np.uint64)).all() and decontaminate.all_set(t, rng.integers(0, 1 << 63, 5000).astype(np.uint64)).mean() < 0.01


def test_decontamination_of_two_variants(spark):
    """Each variant agrees with the item, though the two together don't; chance hits elsewhere don't outvote a passage."""
    item = "Sam sold 12 red and 7 green lamps to Ann"
    variants = ["We know Eve sold 3 red and 9 green lamps to Bob.", "We know Kim sold 8 red and 2 green lamps to Joe."]
    long_item = "There were 12 birds and 15 cats near the old mill, and later 12 dogs came by with 15 mice and a fox"
    passage = long_item.replace("12", "70").replace("15", "30")
    chance = " ".join(f"Note: birds and {i} cats near the old mill, and later {i + 5} rain." for i in range(100, 130))
    assert leaks(spark, item, *variants, " ".join(variants), " ".join([item, *variants])) == [True] * 4
    assert leaks(spark, long_item, passage, chance + " " + passage) == [True, True]


def waterfill(sizes, share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        k = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if k * weight[s] > cap * sizes[s]]
        for s in full or open_:
            out[s] = cap * sizes[s] if full else k * weight[s]
        left -= sum(out[s] for s in full)
        open_ = open_ - set(full) if full else set()
    return out


def test_mixing(spark, docs):
    rows = [(r[0], r[1], r[3]) for r in docs] + [(9001, None, None), (9002, "one two three", None), (9003, "", "zero")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    total = Counter()
    for i, _, s in rows:
        total[s] += size[i]
    target = waterfill(total)
    got = mixing.mix(df).collect()
    assert sorted((tuple(r) for r in got)) == sorted(tuple(r) for r in mixing.mix(df).collect())
    source, taken = {i: s for i, _, s in rows}, Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[s] and r["target"] == pytest.approx(target[s]) and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in total:
        largest = max((size[i] for i in size if source[i] == s), default=0)
        assert abs(taken[s] - target[s]) <= max(1, largest)


def test_dual_meets_targets(spark, docs):
    df = spark.createDataFrame([(r[0], r[1], r[3]) for r in docs], "doc_id long, text string, source string")
    sizes = mixing.token_sizes(df)
    duals = {r["source"]: r for r in mixing.solve_dual(sizes, mixing.source_targets(sizes)).collect()}
    got = Counter()
    for r in sizes.collect():
        d = duals[r["source"]]
        got[r["source"]] += r["size"] * (2.0 if d["lam"] is None else 2 / (1 + math.exp(-d["lam"] * r["size"] / d["mean"])))
    assert all(got[s] == pytest.approx(d["target"], rel=1e-6) for s, d in duals.items())


def test_url_filter_cases(spark):
    day = lambda n: f"2024-01-{n:02d} 00:00:00"
    e = [("x.example.com", "block", day(5)), ("x.example.com", "none", day(10)), ("example.com", "allow", day(7)), ("x.example.com/en", "block", day(8)), (None, "block", day(1)), ("y.org", "block", None), ("y.org", "block", day(2)), ("y.org", "allow", day(2))]
    entries = spark.createDataFrame(e, "pattern string, verdict string, listed_at string").withColumn("listed_at", F.col("listed_at").cast("timestamp"))
    c = [(1, "http://X.example.com/", day(4)), (2, "http://x.example.com/", day(5)), (3, "http://x.example.com:8/", day(9)), (4, "https://u@x.example.com/en/1?q=/", day(9)), (5, "http://x.example.com/a", day(10)), (6, None, day(9)), (7, "http://x.example.com", None), (8, "http://y.org", day(3)), (8, "http://y.org", day(3))]
    captures = spark.createDataFrame(c, "page_id long, url string, fetched_at string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    got = {r["page_id"]: (r["verdict"], r["pattern"], r["n_active"]) for r in urlfilter.filter_urls(captures, entries).collect()}
    assert got == {1: ("pass", None, 0), 2: ("block", "x.example.com", 1), 3: ("block", "x.example.com", 2), 4: ("block", "x.example.com/en", 3), 5: ("allow", "example.com", 1), 6: ("pass", None, 0), 7: ("pass", None, 0), 8: ("block", "y.org", 1)}
    assert urlfilter.filter_urls(captures, entries.limit(0)).where("verdict <> 'pass'").count() == 0 and urlfilter.filter_urls(captures.limit(0), entries).count() == 0


def test_url_filter_sees_through_disguises(spark):
    entries = spark.createDataFrame([("x.example.com", "block", "2024-01-01"), ("y.org/a/b/c/d/e", "block", "2024-01-01"), ("[::1]", "block", "2024-01-01")], "pattern string, verdict string, listed_at string").withColumn("listed_at", F.col("listed_at").cast("timestamp"))
    bad = ["http://x.example.com./", "http://a@b@x.example.com/", "//x.example.com/", "  http://x.example.com", "http://a.x.example.com:80/q", "http:\\\\x.example.com\\y", "HTTP://X.EXAMPLE.COM", "http://y.org/a/b/c/d/e/f", "http://[::1]:80/"]
    good = ["http://x.example.com.evil.net/", "http://y.org/a/b/c/d", "http://z.net/?u=http://x.example.com/", "http://xx.example.com", "x.example.com", "", "http://y.org/" + "a/" * 20_000]
    c = spark.createDataFrame([(i, u) for i, u in enumerate(bad + good)], "page_id long, url string").withColumns({"fetched_at": F.lit("2024-02-01").cast("timestamp"), "host": F.lit("clash"), "verdict": F.lit("clash"), "salt": F.lit(0)})
    got = {r["page_id"]: r["verdict"] for r in urlfilter.filter_urls(c, entries).collect()}
    assert [got[i] for i in range(len(got))] == ["block"] * len(bad) + ["pass"] * len(good)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    duck = duckdb.connect()
    for t in ("pages", "documents"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = duck.sql(registry.ORACLES[name])
    df = registry.QUERIES[name](spark, SF).select(*want.columns)
    assert sorted(str(tuple(r)) for r in df.collect()) == sorted(str(r) for r in want.fetchall())
