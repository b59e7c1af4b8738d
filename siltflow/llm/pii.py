"""Personal data by weak supervision (DataFrame and SQL functions only).

Base spans come from four patterns with checks (email, ip, card, phone). Looser candidates (spaced or worded e-mail
addresses, numbers and names of other shapes, quoted secrets) join them as items on which labelers vote for, against or
not at all: a check of the pattern (ranges, check digits), a gazetteer of domains, country codes and reserved values,
cue words before the span, words before it that speak against, what follows it, and its shape. Counts of vote patterns
are collected (at most 3^6 for each kind); expectation-maximisation estimates how reliable each labeler is and how
likely each pattern is personal data. The expected labels train a final naive Bayes span classifier on the votes and
discrete features, again from grouped counts. Candidates it accepts are added to the base spans, which always stay;
added ones that overlap a base span or an earlier added one are left out.

A text's spans and candidates, with a few characters around them, are found once and kept with its row; the classifier
is an expression over them, so no row is joined or shuffled and ids don't matter. Positions are code points, ends
exclusive. Texts are matched whole; patterns are written without nested backtracking, so that very long texts take
linear time. Null texts are empty and have no spans. Repeated rows are searched each. Ties between candidates at one
start: the longest, then the first kind. An empty table gives no rows. Columns other than doc_id, text and those to
keep are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shared import Scratch, settle, table

KINDS = ("email", "ip", "card", "phone")
LOCAL = r"A-Za-z0-9._%+-"
#: The contract's patterns with possessive groups and run starts; a match begins where a run begins or the last match ended.
BASE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    # the checks drop runs of fewer than 16 digits, so only longer ones are matched; a run begins where none reaches to
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser shapes; each is anchored so that it can't begin inside a run.
LOOSE = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9._%+-]{1,64}+(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}+(?:(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}+)++",
    "phone": r"(?<![0-9.+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3}+)?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_])(?i:password|passwd|token|secret|api[_-]?key)\x20?[=:]\x20?[\"'][^\"'\s]{8,128}+[\"']",
}
ORDER = [*KINDS, *(k for k in LOOSE if k not in KINDS)]
#: Words that announce personal data shortly before it, and words that speak against it.
CUES = r"(?i)(?:e-?mail|mail|contact|write|reach|phone|tel|telephone|call|mobile|cell|fax|card|visa|account|iban|ssn|social|security|address|host|server|password|token|secret|key)(?:\x20(?:me|us|is|no|number|at|to)){0,2}[^A-Za-z0-9]{0,4}$"
AGAINST = r"(?i)(?:version|build|release|isbn|issn|part|model|serial|order|invoice|ticket|case|page|pages|figure|table|section|chapter|range|score|ratio|size|lot|sku|example|sample|placeholder|dummy|fake|test)(?:\x20(?:no|number|code|id|is)){0,2}[^A-Za-z0-9]{0,4}$"
#: What follows numbers that are quantities or parts of longer ones.
FOLLOWS = r"(?i)^(?:[.,-]?[0-9]|\x20?(?:%|px|mm|cm|km|kg|mb|gb|ms|units|points|pcs|items)(?![a-z]))"
STEADY = r"^(.)\1+$|^(?:0|12345678)"
# Top-level domains, country codes of IBANs, and values reserved for examples; (kind, term, vote).
GAZETTEER = [
    *(("email", x, 1) for x in "com org net edu gov info io biz de fr es it nl uk ch at eu us ca au jp".split()),
    *(("email", x, -1) for x in "invalid example test localhost".split()),
    *(("iban", x, 1) for x in "AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT SE".split()),
    *(("phone", x, -1) for x in "000 111 123 999".split()),
    *(("ssn", x, -1) for x in "000 666 987".split()),
    *(("secret", x, -1) for x in "changeme password yourpassword yourtoken placeholder xxxxxxxx ******** your-api-key your_api_key <password> <token>".split()),
]
MOST_GAZETTEER = 10_000


def matches(text: Column, pattern: str) -> Column:
    """(start, end, found) of each leftmost match: lengths of the pieces between matches, summed up."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    zipped = F.arrays_zip(F.transform(found, lambda x: x).alias("f"), F.slice(between, 1, F.size(found)).alias("b"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,found:string>>").alias("out"))

    def step(acc, x):
        begin = acc["at"] + F.length(x["b"])
        end = begin + F.length(x["f"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["f"].alias("found")))).alias("out"))

    return F.when(F.size(found) > 0, F.aggregate(zipped, start, step)["out"]).otherwise(F.array().cast("array<struct<start:int,end:int,found:string>>"))


def luhn(digits: Column) -> Column:
    d = F.transform(F.split(F.reverse(digits), ""), lambda x: x.cast("int"))
    return F.aggregate(F.transform(d, lambda x, i: F.when(i % 2 == 1, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)), F.lit(0), lambda a, x: a + x) % 10 == 0


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def passes(kind: str, found: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        n = F.length(digits_of(found))
        return F.when(n.between(16, 19), luhn(digits_of(found))).otherwise(False)
    if kind == "phone":
        return F.length(digits_of(found)).between(8, 15)
    return F.lit(True)


def _checker(kind: str):
    return lambda s: passes(kind, s["found"])


def _ranked(kind: str) -> Column:
    rank = ORDER.index(kind) + 1
    return F.transform(F.col(kind), lambda s: F.struct(F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end")))


def base_spans(docs: DataFrame) -> DataFrame:
    """docs: ..., text (not null). Adds spans of each base kind: arrays of (start, end, found)."""
    empty = F.array().cast("array<struct<start:int,end:int,found:string>>")
    hint = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+")), "ip": F.col("text").rlike(r"[0-9]\.[0-9]"), "card": F.col("text").rlike(r"[0-9](?:[\x20-]?[0-9]){15}")}
    return docs.withColumns({kind: F.when(hint[kind], F.filter(matches(F.col("text"), BASE[kind]), _checker(kind))).otherwise(empty) for kind in KINDS})


def loose_hint(kind: str) -> Column:
    text = F.col("text")
    return {"email": text.rlike(r"(?:[\[( ])at[\]) ]") & text.rlike(r"(?:[\[( ])dot[\]) ]"), "phone": text.rlike(r"[0-9]{3}[.\x20-][0-9]{4}"), "ssn": text.rlike(r"-[0-9]{2}-"), "iban": text.rlike(r"[A-Z]{2}[0-9]{2}"), "secret": text.rlike("[\"']")}[kind]


VOTES = ("pattern", "gazetteer", "cue", "against", "follows", "shape")
CANDIDATE = "array<struct<kind:string,start:int,end:int,found:string,base:boolean,before:string,after:string>>"


def with_candidates(docs: DataFrame) -> DataFrame:
    """docs: text, base kinds. Adds cands: every span, base or loose, with what stands before and after it."""
    text = F.col("text")

    def tag(spans: Column, kind: str, base: bool) -> Column:
        around = lambda s: (F.substring(text, F.greatest(F.lit(1), s["start"] - 31), F.least(F.lit(32), s["start"])), F.substring(text, s["end"] + 1, F.lit(12)))
        return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found"), F.lit(base).alias("base"), around(s)[0].alias("before"), around(s)[1].alias("after")))

    empty = F.array().cast("array<struct<start:int,end:int,found:string>>")
    every = [tag(F.col(k), k, True) for k in KINDS] + [tag(F.when(loose_hint(k), matches(text, p)).otherwise(empty), k, False) for k, p in LOOSE.items()]
    return docs.withColumn("cands", F.concat(*every).cast(CANDIDATE))


def iban_holds(found: Column) -> Column:
    """The check digits: the account's digits, letters as 10 to 35, after moving four characters to the end, are 1 modulo 97."""
    plain = F.upper(F.regexp_replace(found, r"\x20", ""))
    moved = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")
    step = lambda acc, c: F.when(c.rlike("^[0-9]$"), acc * 10 + F.coalesce(c.try_cast("int"), F.lit(0))).otherwise(acc * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.filter(moved, lambda c: c != ""), F.lit(0), step) == 1


def voted(c: Column, gazetteer: dict[str, int]) -> Column:
    """A candidate with the votes of all labelers (1 for, 0 abstains, -1 against) and discrete features."""
    kind, found, digits = c["kind"], c["found"], digits_of(c["found"])
    vote = lambda yes, no=F.lit(False): F.when(no, -1).when(yes, 1).otherwise(0)
    right = (
        F.when(c["base"], 1)
        .when(kind == "ssn", F.when(digits.rlike(r"^(?:000|666|9)|^...00|0000$"), -1).otherwise(1))
        .when(kind == "iban", F.when(iban_holds(found), 1).otherwise(-1))
        .when(kind == "phone", F.when(digits.rlike("^[2-9][0-9]{2}[2-9]"), 1).otherwise(-1))
        .when(kind == "secret", F.when(F.size(F.array_distinct(F.split(found, ""))) >= 12, 1).otherwise(-1))
        .otherwise(0)
    )
    term = (
        F.when(kind == "email", F.lower(F.regexp_extract(found, r"([A-Za-z0-9-]+)$", 1)))
        .when(kind == "iban", F.substring(found, 1, 2))
        .when(kind.isin("phone", "ssn"), F.substring(digits, 1, 3))
        .when(kind == "secret", F.lower(F.regexp_extract(found, "[\"']([^\"']*)[\"']$", 1)))
        .otherwise("")
    )
    known = F.create_map(*(F.lit(x) for kv in sorted(gazetteer.items()) for x in kv)) if gazetteer else F.create_map(F.lit(""), F.lit(0))
    number = ~kind.isin("email", "secret")
    return F.struct(
        *(c[f].alias(f) for f in ("kind", "start", "end", "base")),
        right.alias("pattern"), F.coalesce(known[F.concat_ws(":", kind, term)], F.lit(0)).alias("gazetteer"), vote(c["before"].rlike(CUES) | (kind == "secret")).alias("cue"),
        vote(F.lit(False), c["before"].rlike(AGAINST)).alias("against"), vote(F.lit(False), number & c["after"].rlike(FOLLOWS)).alias("follows"), vote(~number | (F.length(digits) >= 7), number & digits.rlike(STEADY)).alias("shape"),
        F.floor(F.log2(F.length(found))).cast("int").alias("size"), F.floor(4.0 * F.length(digits) / F.length(found)).cast("int").alias("dense"),
    )


#: What is thought of a labeler before any vote is seen: better than chance. Chances of votes 1, 0, -1 for personal data.
BELIEF = {1: 0.6, 0: 0.35, -1: 0.05}


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]], steps: int = 50, strength: float = 0.05) -> dict[tuple[str, tuple[int, ...]], float]:
    """Expectation-maximisation over (kind, votes, count): the probability that spans with these votes are personal data.

    Each labeler has one chance of each vote for personal data and one for the rest; a kind has a prior. It starts
    from the majority of votes. BELIEF weighs as much as `strength` times the votes, so that the classes keep their
    meaning where almost all spans are of one: else EM would split those by kind.
    """
    weight = 1 + strength * sum(n for *_, n in patterns)
    post = {(k, v): 1 / (1 + math.exp(-1.5 * sum(v))) for k, v, _ in patterns}
    for _ in range(steps):
        prior: dict = defaultdict(lambda: [0.5, 0.5])
        rate: dict = {(i, x): [weight * BELIEF[-x], weight * BELIEF[x]] for _, v, _ in patterns for i in range(len(v)) for x in BELIEF}
        total = [weight, weight]
        for k, v, n in patterns:
            for c, p in enumerate((1 - post[k, v], post[k, v])):
                prior[k][c] += n * p
                total[c] += n * p
                for i, x in enumerate(v):
                    rate[i, x][c] += n * p
        new = {}
        for k, v, _ in patterns:
            odds = math.log(prior[k][1]) - math.log(prior[k][0])
            for i, x in enumerate(v):
                odds += math.log(rate[i, x][1] / total[1]) - math.log(rate[i, x][0] / total[0])
            new[k, v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        moved = max((abs(new[x] - post[x]) for x in new), default=0.0)
        post = new
        if moved < 1e-9:
            break
    return post


FEATURES = ("kind", *VOTES, "size", "dense")


def train(spans: DataFrame) -> tuple[float, dict[str, dict[str, float]]]:
    """Naive Bayes over FEATURES with expected labels: the intercept and the weight of each value. All counts are grouped on the cluster."""
    seen = spans.groupBy(*FEATURES).agg(F.count("*").alias("n")).collect()
    merged: dict = defaultdict(int)
    for r in seen:
        merged[r["kind"], tuple(r[v] for v in VOTES)] += r["n"]
    post = reliabilities([(k, v, n) for (k, v), n in sorted(merged.items())])
    total, counts = [1.0, 1.0], {f: defaultdict(lambda: [0.5, 0.5]) for f in FEATURES}
    for r in seen:
        p = post[r["kind"], tuple(r[v] for v in VOTES)]
        for c, q in enumerate((1 - p, p)):
            total[c] += r["n"] * q
            for f in FEATURES:
                counts[f][str(r[f])][c] += r["n"] * q
    weights = {f: {x: math.log(n[1] / total[1]) - math.log(n[0] / total[0]) for x, n in sorted(counts[f].items())} for f in FEATURES}
    return math.log(total[1]) - math.log(total[0]), weights


def classified(c: Column, model: tuple[float, dict[str, dict[str, float]]]) -> Column:
    """The classifier's probability for a candidate with votes, as an expression."""
    z = F.lit(model[0])
    for f, values in model[1].items():
        if values:
            known = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
            z = z + F.coalesce(known[c[f].cast("string")], F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def gazetteer_terms(gazetteer: DataFrame | None) -> dict[str, int]:
    """'kind:term' and its vote, of a table (kind, term, vote) of at most MOST_GAZETTEER rows, or the built-in one."""
    if gazetteer is None:
        return {f"{k}:{t}": v for k, t, v in GAZETTEER}
    rows = gazetteer.select("kind", "term", F.col("vote").cast("int")).where("kind is not null and term is not null and vote is not null").limit(MOST_GAZETTEER + 1).collect()
    if len(rows) > MOST_GAZETTEER:
        raise ValueError(f"a gazetteer has at most {MOST_GAZETTEER} terms")
    return {f"{k}:{t}": v for k, t, v in sorted(map(tuple, rows))}


def find(docs: DataFrame, accept: float = 0.5, keep: tuple[str, ...] = (), gazetteer: DataFrame | None = None, texts: bool = True) -> DataFrame:
    """docs: doc_id, text. One row for each row of docs: doc_id, text (if texts), each base kind's spans, spans (rank of
    kind, start, end) sorted by kind and start, and kept: a struct of the columns named by keep."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.struct(F.lit(0).alias("_"), *keep).alias("kept"))
    rows = with_candidates(base_spans(own))
    rows = Scratch(docs.sparkSession).keep(rows, "candidates") if texts else settle(rows.drop("text"))
    terms = gazetteer_terms(gazetteer)
    model = train(rows.select(F.explode(F.transform("cands", lambda c: voted(c, terms))).alias("c")).select("c.*"))
    rank = F.array(*map(F.lit, ORDER))
    loose = F.transform(F.filter("cands", lambda c: ~c["base"]), lambda c: voted(c, terms))
    taken = F.filter(loose, lambda c: classified(c, model) >= accept)
    more = F.transform(taken, lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("back"), F.array_position(rank, c["kind"]).cast("int").alias("rank")))
    return rows.withColumn("more", F.array_distinct(more)).select("doc_id", *(["text"] if texts else []), *KINDS, merged_spans().alias("spans"), "kept")


def merged_spans() -> Column:
    """Base spans, and added ones that overlap none of those kept before them."""
    kind = "array<struct<rank:int,start:int,end:int>>"
    base = F.concat(*map(_ranked, KINDS)).cast(kind)
    more = F.coalesce("more", F.array()).cast("array<struct<start:int,back:int,rank:int>>")

    def add(kept, m):
        end = -m["back"]
        clash = F.exists(kept, lambda s: (s["start"] < end) & (m["start"] < s["end"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(F.struct(m["rank"].alias("rank"), m["start"].alias("start"), end.alias("end"))).cast(kind)))

    return F.array_sort(F.when(F.size(more) == 0, base).otherwise(F.aggregate(F.array_sort(more), base, add)))


def digest(spans: Column) -> Column:
    """'kind:start:end' of (rank, start, end), comma-joined."""
    names = F.array(*map(F.lit, ORDER))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span as [KIND]; spans that overlap are cut at the end of the one before."""
    names = F.array(*(F.lit(k.upper()) for k in ORDER))
    placed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank"))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))
        new = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit("["), F.element_at(names, s["rank"]), F.lit("]")).alias("out"))
        return F.when(s["end"] <= acc["at"], acc).otherwise(new)

    done = F.aggregate(placed, begin, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)
    base = F.concat(*map(_ranked, KINDS))
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(digest(base).cast("binary"), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
