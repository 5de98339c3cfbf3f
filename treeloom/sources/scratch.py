"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files of a small scratch table for each core: as many waves of tasks. Larger ones have a file for each ``spark.sql.files.maxPartitionBytes`` that the plan reads.
FILES = 4


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which a cluster must name; only on one machine a temporary folder stands in and is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Rows and bytes of an Arrow batch that goes to a Python task. Spark's own bounds (10,000 rows, 2 GB) hold any number of long texts or of blocks of vectors.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's bounds of an Arrow batch, unless the user has set rows of their own.

    Plans that an operator returns run later, so the setting stays with the session.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def together(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt anew so that all of a key are in one task, for what reads partitions.

    By a hash of the keys: a plain ``repartition`` by keys that a join below is dealt by is left out of the plan, and
    adaptive execution may then split that join's partitions or read them where they were written.
    """
    return df.repartition(F.xxhash64(*keys))


def most_files(df: DataFrame) -> int:
    """Files that a table of this plan may have: ``FILES`` a core, more if what it reads is cut into more by bytes."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    by_bytes = read // spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes() + 1
    return min(2**31 - 1, max(FILES * max(1, spark.sparkContext.defaultParallelism), by_bytes))


#: Lets Spark delete the files that a query has shuffled when it ends.
SHUFFLED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written as Parquet, so that losing an executor loses nothing and lineage ends there. Arrow batches of the session are bounded.

    ``tidy`` folders delete what was shuffled for a table as soon as it is written: for many tables one after another.
    """

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        bounded_batches(spark)
        self.spark, self.base, self.n, self.tidy = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0, tidy

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Writes a table in at most ``most_files`` files, as many small files cost more than they hold."""
        path = self.path(name)
        before = self.spark.conf.get(SHUFFLED, "false")
        if self.tidy:
            self.spark.conf.set(SHUFFLED, "true")
        try:
            df.coalesce(most_files(df)).write.parquet(path)
        finally:
            if self.tidy:
                self.spark.conf.set(SHUFFLED, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        for t in tables:
            delete(self.spark, t._path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
