"""A corpus pipeline of the operators in siltflow.llm; counted as part of that package.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: the columns of documents, but for the last one, which
adds the mix's columns. A runner writes what a stage returns as Parquet and reads it back as the next one's docs.
Decisions apply to rows: a stage that must find a row again numbers them first, so null and repeated ids are neither
skipped nor multiplied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltflow.llm import decontaminate, langid, mixing, pii, simhash
from siltflow.llm.shared import Scratch, fold, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of documents and row_id, written once, so that a row has the same number wherever it is read."""
    return Scratch(spark).keep(docs.select(*COLUMNS).withColumn("row_id", F.monotonically_increasing_id()), "numbered")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Drops texts without letters and texts of which under half of the n-grams are known to any one language; fills null lang."""
    docs = docs.select(*COLUMNS)
    model = langid.train(docs.where(fold("doc_id") != 0))
    kept = langid.annotate(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates on five-word shingles: that with the smallest id, or of a
    group without ids the first row."""
    docs = numbered(spark, docs)
    groups = simhash.near_duplicates(docs.select(F.col("row_id").alias("doc_id"), "text")).select(F.col("doc_id").alias("g_id"), "component_id")
    members = docs.select("doc_id", "row_id").join(groups, F.col("row_id") == F.col("g_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "row_id"))["row_id"]
    kept = members.groupBy("component_id").agg(first.alias("kept"))
    gone = members.join(kept, F.col("row_id") == F.col("kept"), "left_anti").select(F.col("row_id").alias("gone"))
    return docs.join(simhash.few_rows(gone), F.col("row_id") == F.col("gone"), "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain passages of the benchmark, re-parameterised ones included. Texts decide, not ids."""
    docs = docs.select(*COLUMNS).withColumn("key", decontaminate.text_key())
    bad = decontaminate.contaminated(docs.select(F.col("key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    bad = bad.select(F.col("doc_id").alias("bad")).distinct()
    return docs.join(simhash.few_rows(bad), F.col("key") == F.col("bad"), "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind; n_chars follows."""
    found = pii.find(docs, keep=("lang", "source", "n_chars"))
    text = pii.redacted(F.col("text"), F.col("spans"))
    out = found.select("doc_id", text.alias("text"), "kept.lang", "kept.source", F.when(F.size("spans") > 0, F.length(text)).otherwise(F.col("kept.n_chars")).cast("bigint").alias("n_chars"))
    return out.select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the number of copies that the mix takes of it, and what led to it."""
    docs = numbered(spark, docs)
    plan = mixing.mix(docs.select("row_id", "doc_id", "source", "text"), keep=("row_id",))
    plan = plan.drop("doc_id").withColumnRenamed("row_id", "p_id")
    return docs.join(plan, F.col("row_id") == F.col("p_id")).select(*COLUMNS, "size", "source_size", "target", "taken", "copies")


STAGES = [
    ("language identification", language),
    ("near-duplicates", near_dedup),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("mixing", mixture),
]

#: Models, components and roundings can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What each stage returns is written to the shared folder, since the next reads it more than once."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.keep(docs, f"stage{i}")
    return docs
