"""Shared helpers: shared-folder tables, fold numbers, checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nodehours.blocks import scratch_dir

BROADCAST_ROWS = 2_000_000  # rows of a few numbers a side may have to be broadcast; beyond it the join shuffles
BROADCAST_DIGESTS = 400_000  # the same for rows with a digest as text
ARROW_BYTES = "8m"  # of an Arrow batch


class Folder:
    """Tables of one run in the cluster's shared folder; lineage ends at each of them.

    Starting a run keeps the Arrow batches of the session small, so that a task holds a few megabytes of texts at a time.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
        self.spark, self.path = spark, f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and read it back; shuffle files behind it go as soon as it is written."""
        path, conf, clean = f"{self.path}/{name}", self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(clean)
        conf.set(clean, "true")
        try:
            df.write.parquet(path)
        finally:
            conf.set(clean, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def all(self, name: str, schema: str) -> DataFrame:
        """One table of all that was put under name/."""
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/*")

    def drop(self, name: str) -> None:
        """Remove a table of this run that nothing reads any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def body(text: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def fold(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def checked(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow side marked for broadcast if a count bounds it; the join shuffles otherwise.

    The result of the join is the same either way.
    """
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
