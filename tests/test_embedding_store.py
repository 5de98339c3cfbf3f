import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from treeloom.functions.embedding import cache_key
from treeloom.sources.embedding_store import EmbeddingStore
from treeloom.sources.scratch import Scratch

DAY = dt.date(2024, 3, 31)


def lengths(text):
    return F.array(F.length(text).cast("double"))


@pytest.fixture
def plain(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_made_once_then_known_until_too_old(spark, tmp_path):
    store = EmbeddingStore(spark, "store_ttl", str(tmp_path), ttl=30)
    docs = spark.createDataFrame([(1, "one"), (2, None), (3, ""), (4, "one"), (4, "four")], "doc_id int, text string")
    got = lambda day, d=docs: sorted((r.doc_id, r.vector[0], r.cached) for r in store.vectors(d, lengths, day).collect())
    values = [(1, 3.0), (2, 0.0), (3, 0.0), (4, 3.0), (4, 4.0)]
    assert got(DAY) == [(*v, False) for v in values]
    assert spark.table("store_ttl").count() == 3
    assert got(DAY + dt.timedelta(days=29)) == [(*v, True) for v in values]
    assert got(DAY + dt.timedelta(days=30)) == [(*v, False) for v in values]
    assert got(DAY, docs.limit(0)) == []
    # the latest vector counts; what is dropped is gone for a session that opens the folder anew, too
    store.add(spark.createDataFrame([("one", [-1.0])], "text string, vector array<double>").select(cache_key(F.col("text")).alias("cache_key"), "vector"), DAY + dt.timedelta(days=31))
    assert store.expire(DAY + dt.timedelta(days=31)) == 1
    again = EmbeddingStore(spark, "store_again", str(tmp_path), ttl=30)
    assert sorted(r.vector[0] for r in again.live(DAY + dt.timedelta(days=31)).collect()) == [-1.0, 0.0, 4.0]
    assert again.live(DAY).count() == 0


def test_store_is_neither_shuffled_nor_read_beyond_its_days(plain, tmp_path):
    store = EmbeddingStore(plain, "store_plan", str(tmp_path), ttl=2)
    keys = plain.range(1000).select(F.col("id").cast("string").alias("cache_key"), F.array(F.col("id").cast("double")).alias("vector"))
    for back in range(4):
        store.add(keys, DAY - dt.timedelta(days=back))
    plan = store.known(keys.where("vector[0] < 500"), DAY)._jdf.queryExecution().executedPlan().toString()
    store_side = plan[plan.index("max_by") :]
    assert plan.count("Exchange") == 1 and "Exchange" not in store_side
    assert "SelectedBucketsCount: 4 out of 4" in store_side and re.search(r"PartitionFilters: \[isnotnull\(day", store_side)
    assert store.known(keys, DAY).where("vector[0] = cast(cache_key AS double)").count() == 1000


def test_scratch_files_grow_with_bytes(spark, tmp_path):
    spark.range(200000).repartition(40).write.parquet(f"{tmp_path}/t")
    files = lambda: len(Scratch(spark, "files").save(spark.read.parquet(f"{tmp_path}/t")).inputFiles())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    few = files()
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(32 << 10))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert few <= 16 < files()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
