"""Embedders: what turns a column of texts into a column of vectors, and batches that a cache answers in part."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prefixed(text: Column, query: str = "query", passage: str = "passage: ") -> Column:
    """Texts that do not begin with ``query`` are passages and say so; null stays null."""
    return F.when(text.startswith(query), text).otherwise(F.concat(F.lit(passage), text))


def embedder(model: Callable[[list[str]], np.ndarray], batch: int = 2048) -> Callable[[Column], Column]:
    """A plug-in from texts to array<double>: ``model`` gets at most ``batch`` texts at once, line breaks as spaces.

    A null text has no vector. What the model needs to load it should load once, at its first call in a worker.
    """

    @F.arrow_udf("array<double>")
    def embed(texts: pa.Array) -> pa.Array:
        given = [t.replace("\n", " ") for t in texts.to_pylist() if t is not None]
        vectors = [v for at in range(0, len(given), batch) for v in np.asarray(model(given[at : at + batch]), float).tolist()]
        rest = iter(vectors)
        return pa.array([next(rest) if t.is_valid else None for t in texts], pa.list_(pa.float64()))

    return lambda text: embed(text)


def vectors_of(text: Column, models: dict[str, Callable[[Column], Column]]) -> Column:
    """Map from a model's name to its vector of a text."""
    return F.create_map(*(x for name, embed in models.items() for x in (F.lit(name), embed(text))))


def cache_key(text: Column, model: str = "model") -> Column:
    """First 16 hexadecimal digits of the SHA-256 of model and text; a null text counts as empty."""
    return F.substring(F.sha2(F.concat(F.lit(f"{model}:"), F.coalesce(text, F.lit(""))).cast("binary"), 256), 1, 16)


def cached_vectors(docs: DataFrame, cache: DataFrame, embed: Callable[[Column], Column], model: str = "model") -> DataFrame:
    """(doc_id, vector, cached): vectors of docs (doc_id, text); those that cache (cache_key, vector) lacks are made, each text once.

    Texts are shuffled only if the cache lacks them. Rows with one doc_id get a row each; the cache has one row a key.
    """
    keyed = docs.select("doc_id", "text", cache_key(F.col("text"), model).alias("cache_key"))
    missing = keyed.select("cache_key").join(cache.select("cache_key"), "cache_key", "left_anti").distinct()
    texts = keyed.join(missing, "cache_key", "left_semi").groupBy("cache_key").agg(F.first("text").alias("text"))
    made = texts.select("cache_key", embed(F.coalesce("text", F.lit(""))).alias("vector"), F.lit(False).alias("cached"))
    known = cache.select("cache_key", "vector", F.lit(True).alias("cached")).unionByName(made)
    return keyed.select("doc_id", "cache_key").join(known, "cache_key").select("doc_id", "vector", "cached")


def request_stats(requests: DataFrame) -> DataFrame:
    """(total, hit_rate, avg_time, batch_share) of requests (cache_hit, batch_size, seconds); no requests: zeros."""
    n = F.greatest(F.count("*"), F.lit(1))
    return requests.agg(
        F.count("*").alias("total"), (F.count_if("cache_hit") / n).alias("hit_rate"), (F.coalesce(F.sum("seconds"), F.lit(0.0)) / n).alias("avg_time"), (F.count_if(F.col("batch_size") > 1) / n).alias("batch_share")
    )
