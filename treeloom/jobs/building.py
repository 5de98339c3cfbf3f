"""Queries of tree building: parameters, memos, summaries and vectors of parents, clusters and their quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from treeloom.functions import text as T
from treeloom.functions.vector import usable
from treeloom.jobs import texts as X
from treeloom.operators import clusters as C
from treeloom.operators import mixtures as M
from treeloom.operators import tree as B
from treeloom.sources.scratch import Scratch


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def adaptive_parameters(spark, sf):
    """Dimension and threshold of a layer (here a source) by the lengths of its texts, from 10 and 0.1."""
    n = _table(spark, sf, "documents").groupBy("source").agg(F.avg(F.length("text")).alias("mean"), F.max(F.length("text")).alias("high"))
    dim = F.when(F.col("mean") > 500, 12).when(F.col("mean") < 100, 8).otherwise(10)
    return n.select("source", dim.cast("long").alias("dim"), F.when(F.col("high") > 3 * F.col("mean"), 0.09).otherwise(0.1).alias("threshold"))


def cluster_memo(spark, sf):
    """Clusters (here conversations) by the hash of their texts' sorted first 50 characters, and the first cluster of each hash.

    A cluster's prefixes are one array of 50 characters a member.
    """
    c = _table(spark, sf, "conversations").where("text IS NOT NULL")
    key = F.md5(F.array_join(F.array_sort(F.collect_list(F.substring("text", 1, 50))), ""))
    k = c.groupBy("conv_id").agg(key.alias("memo"))
    return k.join(k.groupBy("memo").agg(F.min("conv_id").alias("first_conv")), "memo")


def parent_summary(spark, sf):
    """A parent's text (here a source's): its members' first sentences in order, up to 100 tokens."""
    d = _table(spark, sf, "documents").select(F.col("source").alias("parent_id"), F.col("doc_id").alias("node_id"), "text")
    return B.summaries(d, 100).withColumnRenamed("parent_id", "source")


def parent_vectors(spark, sf):
    """The mean vector of each label, of length 1, component by component."""
    m = B.means(_table(spark, sf, "embeddings").select(F.col("label").alias("parent_id"), "embedding"))
    return m.select(F.col("parent_id").alias("label"), F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round("x", 6))


def _grouped(spark, sf, size):
    e = _table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / size).alias("group"), F.col("vec_id").alias("node_id"), "embedding")
    return C.group_clusters(e)


def pair_clusters(spark, sf):
    """Vectors two by two: one cluster or two."""
    return _grouped(spark, sf, 2).select("group", "node_id", "cluster")


def ward_clusters(spark, sf):
    """Vectors in groups of seven: Ward's clusters with the best silhouette."""
    return _grouped(spark, sf, 7).withColumn("silhouette", F.round("silhouette", 6))


def mixture_clusters(spark, sf):
    """Vectors in groups of forty: principal components and mixtures, soft."""
    return _grouped(spark, sf, 40).withColumn("silhouette", F.round("silhouette", 6))


def cluster_methods(spark, sf):
    """How many groups of each size are clustered in which way; a group's size is 1 to 24."""
    e = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding")
    g = e.select(((F.floor(F.col("node_id") / 24)) * 25 + F.floor((F.sqrt(8 * (F.col("node_id") % 24) + 1) - 1) / 2)).alias("group"), "node_id", "embedding")
    return C.group_clusters(g).groupBy("group").agg(F.count_distinct("node_id").alias("n"), F.min("method").alias("method"))


def divided_clusters(spark, sf):
    """Vectors with 20 to 116 tokens each, halved until clusters are within 3500 tokens or three levels deep."""
    e = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), (F.col("vec_id") % 97 + 20).alias("n_tokens"), "embedding")
    return C.divide(e)


def cluster_quality(spark, sf):
    q = C.quality(_table(spark, sf, "embeddings").select("embedding", "label"))
    return q.select("n", "k", *(F.round(c, 4).alias(c) for c in ("inertia", "calinski_harabasz", "silhouette")), "accepted")


def optimal_clusters(spark, sf):
    """The best number of clusters of all vectors, of up to 50, by ten principal components."""
    e = Scratch(spark, "optimal").save(_table(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding").where(usable(F.col("embedding"))), "vectors")
    n = e.count()
    x = M.reduced(e, n, 10).withColumnRenamed("x", "embedding") if n > 2 else e
    return spark.createDataFrame([(C.optimal_clusters(x),)], "k int")


QUERIES = {f.__name__: f for f in (adaptive_parameters, cluster_memo, parent_summary, parent_vectors, pair_clusters, ward_clusters, mixture_clusters, cluster_methods, divided_clusters, cluster_quality, optimal_clusters)}

_FIRST = X._SENT.format(X._ONE.format("text"))
ORACLES = {
    "pair_clusters": "WITH v AS (SELECT vec_id // 2 AS g, vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id AS second FROM v a JOIN v b ON a.g = b.g AND a.vec_id > b.vec_id WHERE NOT list_cosine_similarity(a.e, b.e) > 0.1) SELECT g AS \"group\", vec_id AS node_id, (vec_id IN (SELECT second FROM p))::INT AS cluster FROM v",
    "cluster_methods": "SELECT g AS \"group\", count(*)::BIGINT AS n, CASE WHEN count(*) >= 20 THEN 'mixture' WHEN count(*) >= 8 THEN 'components' WHEN count(*) >= 3 THEN 'hierarchical' WHEN count(*) = 2 THEN 'distance' ELSE 'none' END AS method FROM (SELECT (vec_id // 24 * 25 + floor((sqrt(8 * (vec_id % 24) + 1) - 1) / 2))::BIGINT AS g FROM embeddings) GROUP BY g",
    "cluster_quality": """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
m AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.e, b.e)) AS s, sum(list_distance(a.e, b.e) ** 2) AS q, count(*) AS n FROM v a, v b GROUP BY ALL),
s AS (SELECT vec_id, sum(s / greatest(n - 1, 1)) FILTER (own = other) AS a, min(s / n) FILTER (own <> other) AS b, max(n) FILTER (own = other) AS n FROM m GROUP BY vec_id),
sil AS (SELECT avg(CASE WHEN n = 1 OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS sil FROM s),
w AS (SELECT sum(q / n) / 2 AS w FROM m WHERE own = other), t AS (SELECT sum(q) / 2 / (SELECT count(*) FROM v) AS t FROM m),
c AS (SELECT count(*)::BIGINT AS n, count(DISTINCT label)::BIGINT AS k FROM v)
SELECT n, k, round(w, 4) AS inertia, round((t - w) / (k - 1) / (w / (n - k)), 4) AS calinski_harabasz, round(sil, 4) AS silhouette, sil >= 0.2 AS accepted FROM c, w, t, sil""",
    "adaptive_parameters": "SELECT source, (CASE WHEN avg(length(text)) > 500 THEN 12 WHEN avg(length(text)) < 100 THEN 8 ELSE 10 END)::BIGINT AS dim, CASE WHEN max(length(text)) > 3 * avg(length(text)) THEN 0.09::DOUBLE ELSE 0.1::DOUBLE END AS threshold FROM documents GROUP BY source",
    "cluster_memo": "WITH k AS (SELECT conv_id, md5(array_to_string(list_sort(list(substr(text, 1, 50))), '')) AS memo FROM conversations WHERE text IS NOT NULL GROUP BY conv_id) SELECT memo, conv_id, min(conv_id) OVER (PARTITION BY memo) AS first_conv FROM k",
    "parent_summary": f"WITH d AS (SELECT source, doc_id, {_FIRST}[1] AS s FROM documents), n AS (SELECT *, {X._N.format('s')} AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, sum({X._N.format('s')}) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM d WHERE s IS NOT NULL) SELECT source, string_agg(s, ' ' ORDER BY doc_id) AS text, sum(k)::BIGINT AS n_tokens FROM n WHERE upto <= 100 OR rank = 1 GROUP BY source",
    "parent_vectors": "WITH c AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(len(embedding)))::INTEGER AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, i) SELECT label, i, round(x / greatest(sqrt(sum(x * x) OVER (PARTITION BY label)), 1e-12), 6) AS x FROM c",
}
