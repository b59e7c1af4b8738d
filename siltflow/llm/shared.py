"""What the operators of this package share: folds, shared storage, word patterns."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo `folds` (null ids: fold of the empty text, 0)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = os.environ.setdefault("SILTFLOW_SHARED_DIR", tempfile.mkdtemp(prefix="siltflow-"))
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage: checkpoint() into the shared folder, which survives lost executors."""
    shared_dir(df.sparkSession)
    held = df.persist()  # checkpoint() alone computes twice
    out = held.checkpoint()
    held.unpersist()
    return out


class Scratch:
    """Parquet tables in the shared folder, for intermediates too large for settle(): computed once, compressed.
    Results may read them lazily, so they stay until close() or the driver's end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        atexit.unregister(self.close)
        if self.spark.sparkContext._jsc is None:  # stopped
            return
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
