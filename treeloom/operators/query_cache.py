"""A cache of query results as a table: exact and similar lookups, insertion with eviction, sweeping.

Entries are (query_hash, query, params, embedding, ts, accessed, result); params is a map of strings.
A cache is a DataFrame, and what changes it gives the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.operators.retrieval import nearest

TTL, SIZE, SIMILAR = 3600, 1000, 0.95


def params_text(params: Column) -> Column:
    """Parameters in order of their names; a null map is an empty one."""
    pairs = F.array_sort(F.map_entries(F.coalesce(params, F.expr("cast(map() as map<string,string>)"))))
    return F.concat(F.lit("["), F.array_join(F.transform(pairs, lambda p: F.concat(F.lit("("), p["key"], F.lit(", "), F.coalesce(p["value"], F.lit("None")), F.lit(")"))), ", "), F.lit("]"))


def query_hash(query: Column, params: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of query and parameters."""
    return F.substring(F.sha2(F.concat(query, F.lit(":"), params_text(params)).cast("binary"), 256), 1, 16)


def _age(now: Column) -> Column:
    return now.cast("double") - F.col("ts").cast("double")


def lookup(requests: DataFrame, cache: DataFrame, ttl: int = TTL) -> DataFrame:
    """(query_id, hit, result) of requests (query_id, query, params, now): entries older than the limit are no hits."""
    r = requests.select("query_id", query_hash(F.col("query"), F.col("params")).alias("query_hash"), "now")
    found = r.join(cache.select("query_hash", "ts", "result"), "query_hash", "left")
    valid = F.coalesce(_age(F.col("now")) < ttl, F.lit(False))
    return found.select("query_id", valid.alias("hit"), F.when(valid, F.col("result")).alias("result"))


def touched(cache: DataFrame, requests: DataFrame, ttl: int = TTL) -> DataFrame:
    """The cache after exact lookups: valid entries that were asked for are accessed then, invalid ones that were are gone."""
    asked = requests.select(query_hash(F.col("query"), F.col("params")).alias("h"), "now").groupBy("h").agg(F.max("now").alias("now"))
    out = cache.join(asked, F.col("query_hash") == F.col("h"), "left").where(F.col("h").isNull() | (_age(F.col("now")) < ttl))
    return out.select(*(F.coalesce("now", "accessed").alias("accessed") if c == "accessed" else F.col(c) for c in cache.columns))


def similar(requests: DataFrame, cache: DataFrame, threshold: float = SIMILAR, ttl: int = TTL) -> DataFrame:
    """(query_id, entry_id, similarity): for requests (query_id, q, params) the most similar valid entry (entry_id, embedding, params, ts, now) of the same parameters.

    Similarity is 1 - L2 and must be over the threshold; ties go to the smaller entry_id.
    """
    valid = cache.where(_age(F.col("now")) < ttl).select(F.col("entry_id").alias("node_id"), "embedding", params_text(F.col("params")).alias("p"))
    hits = nearest(requests.select("query_id", "q", params_text(F.col("params")).alias("p")), valid, 1, "l2", by="p")
    return hits.select("query_id", F.col("node_id").alias("entry_id"), (1 - F.col("d")).alias("similarity")).where(F.col("similarity") > threshold)


def inserted(cache: DataFrame, new: DataFrame, size: int = SIZE) -> DataFrame:
    """The cache with new entries in place of those of their hash, and only the ``size`` accessed last; ties by hash."""
    all_ = cache.join(new.select("query_hash"), "query_hash", "left_anti").unionByName(new.groupBy("query_hash").agg(*(F.max_by(c, "accessed").alias(c) for c in new.columns if c != "query_hash")))
    return all_.orderBy(F.desc("accessed"), "query_hash").limit(size)


def swept(cache: DataFrame, now: str, ttl: int = TTL) -> DataFrame:
    """The cache without entries older than the limit; one of just that age stays, though lookups no longer give it."""
    return cache.where(_age(F.lit(now).cast("timestamp")) <= ttl)
