"""A store of embeddings in buckets by key hash and partitions by day.

A lookup sorts and shuffles only the keys that are asked for: the store's files lie in the
buckets that the join needs already. What is too old is left out by its partition, unread, and
goes as whole partitions.

Cases: a null text counts as empty; of several vectors of a key the one of the latest day counts;
an empty store answers nothing, so all vectors are made; rows with one doc_id get a row each.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.functions.embedding import cache_key
from treeloom.sources.scratch import Scratch, delete, exists


class EmbeddingStore:
    """Table ``name`` of (cache_key, vector, day) under ``path``, a folder that all executors share.

    ``buckets`` belong to the folder: another number is another store there. Fewer than the session's shuffle
    partitions would make Spark shuffle the store, so these are the default. Vectors live for ``ttl`` days.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int | None = None, ttl: int = 30):
        self.spark, self.name, self.ttl = spark, name, ttl
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = f"{path.rstrip('/')}/{self.buckets}-buckets"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (cache_key STRING, vector ARRAY<DOUBLE>, day DATE) USING parquet PARTITIONED BY (day) "
            f"CLUSTERED BY (cache_key) SORTED BY (cache_key) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        if exists(spark, self.path):
            spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")

    def add(self, vectors: DataFrame, day: dt.date) -> None:
        """Appends (cache_key, vector) made on ``day``: one file a bucket."""
        rows = vectors.select("cache_key", "vector", F.lit(day).alias("day")).repartition(self.buckets, "cache_key")
        rows.write.format("parquet").mode("append").partitionBy("day").bucketBy(self.buckets, "cache_key").sortBy("cache_key").saveAsTable(self.name)

    def live(self, today: dt.date) -> DataFrame:
        """(cache_key, vector), one row a key, of the last ``ttl`` days up to ``today``."""
        rows = self.spark.table(self.name).where(F.col("day").between(F.lit(today - dt.timedelta(days=self.ttl - 1)), F.lit(today)))
        return rows.groupBy("cache_key").agg(F.max_by("vector", "day").alias("vector"))

    def known(self, keys: DataFrame, today: dt.date) -> DataFrame:
        """The distinct ``cache_key`` of ``keys`` with their vector, null where the store has none."""
        return keys.select("cache_key").distinct().join(self.live(today), "cache_key", "left")

    def vectors(self, docs: DataFrame, embed: Callable[[Column], Column], today: dt.date, model: str = "model") -> DataFrame:
        """(doc_id, vector, cached) of docs (doc_id, text); vectors that the store lacks are made, each text once, and added."""
        ws = Scratch(self.spark, "embedding_store")
        keyed = docs.select("doc_id", "text", cache_key(F.col("text"), model).alias("cache_key"))
        found = ws.save(self.known(keyed, today), "found")
        texts = keyed.join(found.where("vector IS NULL").select("cache_key"), "cache_key", "left_semi").groupBy("cache_key").agg(F.first("text").alias("text"))
        made = ws.save(texts.select("cache_key", embed(F.coalesce("text", F.lit(""))).alias("vector")), "made")
        self.add(made, today)
        all_ = found.where("vector IS NOT NULL").withColumn("cached", F.lit(True)).unionByName(made.withColumn("cached", F.lit(False)))
        return keyed.select("doc_id", "cache_key").join(all_, "cache_key").select("doc_id", "vector", "cached")

    def expire(self, today: dt.date) -> int:
        """Drops the partitions that are too old, files included, and says how many."""
        days = [r[0].split("=")[1] for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect()]
        old = [d for d in days if dt.date.fromisoformat(d) <= today - dt.timedelta(days=self.ttl)]
        for d in old:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (day = DATE '{d}')")
            delete(self.spark, f"{self.path}/day={d}")  # the table is external, so its files stay
        return len(old)
