"""Mixing sources to target weights by entropy balancing (DataFrame functions only).

Each source has a token target. Among all copy counts in 0, 1, 2 whose expected tokens meet it, entropy
balancing takes the distribution nearest to the base Binomial(2, 1/2), one expected copy a document. Its dual
is convex: a document with a = tokens / mean tokens of its source gets the exponentially tilted rate
2 * exp(l*a) / (1 + exp(l*a)), with one multiplier l for each source. Newton steps, guarded by a bracket, solve
all sources at once; each step is one aggregation over a (source, size) histogram. Rates become copies by
priority rounding: whole parts are taken, then documents by hash / fraction until the source's target is met.

Nulls: a null text has size 0, a null source is a source of its own, sorted last; null ids are kept. Repeated
rows are documents of their own. An empty table gives an empty result. Columns other than doc_id, text and
source are ignored, so clashing names can't occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .shared import WORD, settle, table

#: Buckets of the rounding order within a source; only the bucket in which the target falls is sorted.
ROUNDING_BUCKETS = 4096


def token_sizes(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(*keep, "doc_id", "source", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, mean, target. The windows here run over one row for each source.

    k is the level at which sum(min(cap * size, k * weight)) is the whole budget: sources sorted by the level at
    which they are full, the first whose level isn't below the level left for the rest ends the full ones.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.nullif(F.avg("size"), F.lit(0.0)).alias("mean"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    picked = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    per = per.withColumn("weight", picked).withColumn("full", cap * F.col("source_size") / F.col("weight"))
    whole, by_full = W.partitionBy(), W.orderBy("full", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum(cap * F.col("source_size")).over(by_full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = share * F.sum("source_size").over(whole) - before
    per = per.withColumn("k", left / F.sum("weight").over(by_full.rowsBetween(W.currentRow, W.unboundedFollowing)))
    level = F.min(F.when(F.col("k") <= F.col("full"), F.struct("full", "k"))).over(whole)["k"]
    return per.withColumn("target", F.least(cap * F.col("source_size"), level * F.col("weight"))).select("source", "source_size", "mean", "target")


def tilt(lam: Column, a: Column) -> Column:
    return 2.0 / (1.0 + F.exp(-lam * a))


def solve_dual(sizes: DataFrame, targets: DataFrame, tolerance: float = 1e-7, steps: int = 60) -> DataFrame:
    """targets with lam, the dual's solution; null where the target is twice the size, which every rate of 2 meets."""
    free = (F.col("target") < 2 * F.col("source_size") * (1 - 1e-12)) & (F.col("target") > 0)
    hist = settle(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")))
    inf = float("inf")
    state = settle(targets.withColumns({"lam": F.when(free, 0.0), "lo": F.lit(-inf), "hi": F.lit(inf), "off": F.lit(inf)}))
    for _ in range(steps):
        a = F.col("size") / F.col("mean")
        rate = tilt(F.col("lam"), a)
        s = state.where(free).alias("s")
        moments = hist.alias("h").join(s, F.col("h.source").eqNullSafe(F.col("s.source"))).groupBy(F.col("h.source").alias("source")).agg(
            F.sum(F.col("n") * a * rate).alias("got"), F.sum(F.col("n") * a * a * rate * (1 - rate / 2)).alias("slope"))
        m = moments.select(F.col("source").alias("m_source"), "got", "slope")
        gap = F.col("got") - F.col("target") / F.col("mean")
        j = state.join(m, state.source.eqNullSafe(m.m_source), "left")
        j = j.withColumns({"lo": F.when(gap < 0, F.greatest("lo", "lam")).otherwise(F.col("lo")), "hi": F.when(gap > 0, F.least("hi", "lam")).otherwise(F.col("hi"))})
        newton = F.col("lam") - gap / F.greatest(F.col("slope"), F.lit(1e-300))
        wide = F.when(F.col("hi") == inf, 2 * F.abs("lam") + 1).when(F.col("lo") == -inf, -2 * F.abs("lam") - 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        ahead = (newton > F.col("lo")) & (newton < F.col("hi")) & (F.abs(newton) <= 8 * F.abs(F.col("lam")) + 8)
        done = F.abs(gap) <= tolerance * F.col("target") / F.col("mean")
        state = settle(j.select("source", "source_size", "mean", "target", F.when(F.col("got").isNull() | done, F.col("lam")).when(ahead, newton).otherwise(wide).alias("lam"), "lo", "hi", F.when(free & ~done, F.abs(gap)).otherwise(F.lit(0.0)).alias("off")))
        if not state.where("off > 0").head(1):
            break
    else:
        raise RuntimeError(f"targets aren't met after {steps} Newton steps")
    return state.select("source", "source_size", "mean", "target", "lam")


def mix(docs: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: the columns that keep names, doc_id, size, source_size, target, taken, copies, rate."""
    sizes = settle(token_sizes(docs, keep=keep))
    duals = solve_dual(sizes, source_targets(sizes, weights, share))
    t = duals.withColumnRenamed("source", "t_source")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("lam").isNull(), F.when(F.col("target") > 0, 2.0).otherwise(0.0)).otherwise(tilt(F.col("lam"), F.col("size") / F.col("mean")))
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "size", F.lit(seed)), 11) + 0.5) / float(1 << 53)
    rows = sizes.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source").withColumn("rate", rate)
    rows = rows.withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole"))
    p = u / F.nullif(F.col("part"), F.lit(0.0))
    rows = rows.withColumn("at", F.when((F.col("part") > 0) & (F.col("size") > 0), p / (1 + p))).withColumn("bucket", F.least(F.floor(F.col("at") * ROUNDING_BUCKETS), F.lit(ROUNDING_BUCKETS - 1)))
    per = rows.groupBy("source", "bucket").agg(F.sum("size").alias("room"), F.sum(F.col("whole") * F.col("size")).alias("sure"), F.first("target").alias("goal"))
    of = W.partitionBy("source")
    per = per.withColumn("need", F.col("goal") - F.sum("sure").over(of)).where("bucket is not null")
    per = per.withColumn("cum", F.sum("room").over(of.orderBy("bucket")))
    cut = per.where("cum >= need").groupBy("source").agg(F.min(F.struct("bucket", (F.col("need") - F.col("cum") + F.col("room")).alias("left"))).alias("cut"))
    cut = cut.select(F.col("source").alias("c_source"), F.col("cut.bucket").alias("cut"), F.col("cut.left").alias("left"))
    rows = rows.join(cut, F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source")
    at_cut = F.col("bucket") == F.col("cut")
    out = lambda df, more: df.select(*keep, "doc_id", "size", "source_size", "target", (F.when(F.col("size") == 0, 1).otherwise(F.col("whole") + more)).cast("long").alias("copies"), "rate")
    rest = out(rows.where(F.coalesce(~at_cut, F.lit(True))), F.when(F.col("bucket").isNull(), 0).when(F.col("cut").isNull() | (F.col("bucket") < F.col("cut")), 1).otherwise(0))
    run = F.sum("size").over(W.partitionBy("source").orderBy("at", "doc_id", "size", *keep).rowsBetween(W.unboundedPreceding, W.currentRow))
    edge = out(rows.where(at_cut).withColumn("run", run), F.when(F.col("run") - F.col("size") / 2 <= F.col("left"), 1).otherwise(0))
    both = rest.unionByName(edge)
    return both.select(*keep, "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
