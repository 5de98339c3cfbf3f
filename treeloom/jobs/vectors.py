"""Queries over embeddings: neighbours by five measures, budgets, selection, descent, similar cache entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.functions import text as T
from treeloom.functions.vector import distance
from treeloom.operators import index as I
from treeloom.operators import query_cache as Q
from treeloom.operators import retrieval as R
from treeloom.operators import ward as W
from treeloom.sources.scratch import Scratch


def _nodes(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("node_id"), "embedding", "label")


def _queries(nodes: DataFrame, every: int = 20) -> DataFrame:
    return nodes.where(F.col("node_id") % every == 0).select(F.col("node_id").alias("query_id"), F.col("embedding").alias("q"))


def _tokens(node_id="node_id"):
    """A node's size, which follows from its id."""
    return (F.col(node_id) % 97 + 20).alias("n_tokens")


def _knn(metric):
    def run(spark, sf):
        n = _nodes(spark, sf)
        return R.knn(_queries(n), n.select("node_id", "embedding"), 10, metric)

    return run


def ann_budget(spark, sf):
    """The 35 best by inner product (3500 tokens of context, chunks of 100), until 3500 tokens are used, overshooting by one."""
    n = _nodes(spark, sf)
    hits = R.nearest(_queries(n), n.select("node_id", "embedding"), 35, "inner").select("query_id", "rank", "node_id", _tokens())
    return R.within_budget(hits, 3500, "inclusive").select("query_id", "rank", "node_id", "upto")


def budget_strict(spark, sf):
    """Nearest by cosine within 200 tokens; a first one that is too large leaves nothing."""
    n = _nodes(spark, sf)
    hits = R.nearest(_queries(n), n.select("node_id", "embedding"), 10).select("query_id", "rank", "node_id", _tokens())
    return R.within_budget(hits, 200).select("query_id", "rank", "node_id", "upto")


def threshold_select(spark, sf):
    """Of the ten nearest those within 0.7, and those beyond it."""
    n = _nodes(spark, sf)
    hits = R.nearest(_queries(n), n.select("node_id", "embedding"), 10)
    kept = [R.select(hits, "threshold", threshold=0.7, sense=s).select("query_id", "rank", "node_id", F.lit(s).alias("sense")) for s in ("within", "reference")]
    return kept[0].unionByName(kept[1])


def _centroids(n: DataFrame) -> DataFrame:
    e = n.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return e.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).select((-F.col("label") - 1).cast("long").alias("node_id"), F.expr("transform(c, p -> p.x)").alias("embedding"))


def beam_two_level(spark, sf):
    """The two nearest label centroids (ids below 0), then the two nearest of their members."""
    n = _nodes(spark, sf)
    edges = n.select((-F.col("label") - 1).cast("long").alias("parent_id"), F.col("node_id").alias("child_id"))
    hits = R.beam(_queries(n), _centroids(n), [n.select("node_id", "embedding")], edges, 2)
    return hits.withColumn("d", F.round("d", 6) + 0.0)


def cluster_inertia(spark, sf):
    n = _nodes(spark, sf)
    c = _centroids(n).select((-F.col("node_id") - 1).alias("l"), F.col("embedding").alias("c"))
    d = n.join(c, F.col("label") == F.col("l")).withColumn("d", distance(F.col("embedding").cast("array<double>"), F.col("c"), "l2"))
    return d.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(F.col("d") * F.col("d")), 6).alias("inertia"))


def similar_cache(spark, sf):
    """For each query the most similar valid entry of its parameters (the parity of the label) over 0.2."""
    n = _nodes(spark, sf)
    params = F.create_map(F.lit("top_k"), (F.col("label") % 2).cast("string")).alias("params")
    now = F.timestamp_seconds(F.lit(10_000))
    cache = n.where("node_id % 20 <> 0").select(F.col("node_id").alias("entry_id"), "embedding", params, F.timestamp_seconds(5000 + F.col("node_id") % 3000).alias("ts"), now.alias("now"))
    asked = n.where("node_id % 20 = 0").select(F.col("node_id").alias("query_id"), F.col("embedding").alias("q"), params)
    return Q.similar(asked, cache, 0.2).withColumn("similarity", F.round("similarity", 6))


def _indexed(metric):
    """The ten nearest from a saved index."""

    def run(spark, sf):
        n = _nodes(spark, sf)
        index = I.build(n.select("node_id", "embedding"), Scratch(spark, "indexes").path(metric), metric)
        hits = I.load(spark, index.path).search(_queries(n))
        if metric == "inner":
            return hits.select("query_id", "rank", "node_id", (F.round(-F.col("d"), 6) + 0.0).alias("score"))
        return hits.select("query_id", "rank", "node_id", (F.round("d", 6) + 0.0).alias("distance"))

    return run


def index_chunks(spark, sf):
    """The five chunks of all documents that are nearest to each text of the benchmark, and how many cells of their index were read."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    index = I.from_documents(docs, T.letter_vector, Scratch(spark, "indexes").path("chunks"))
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").select((-F.col("item_id") - 1).alias("query_id"), T.letter_vector(F.col("text")).alias("q"))
    return index.search(asked, 5).withColumn("d", F.round("d", 6) + 0.0)


def ward_cut(spark, sf):
    """All vectors as one group: Ward's cut into four."""
    e = _nodes(spark, sf).select(F.lit(0).alias("g"), F.col("node_id").alias("id"), F.col("embedding").alias("vec"))
    return W.cuts(e, 4).select(F.col("id").alias("node_id"), F.get("labels", F.lit(2)).alias("cluster"))


def early_termination(spark, sf):
    """What a reader of 200 tokens takes of the ten nearest; the confidence is low enough that both ways past a full budget are taken."""
    n = _nodes(spark, sf)
    hits = R.nearest(_queries(n), n.select("node_id", "embedding"), 10).select("*", _tokens())
    return R.ends_early(hits, BUDGET, SURE)


BUDGET, SURE = 200, 0.4
QUERIES = {"knn_cosine": _knn("cosine"), "knn_l1": _knn("l1"), "knn_l2": _knn("l2"), "knn_linf": _knn("linf"), "knn_inner_product": _knn("inner")}
QUERIES |= {"index_cosine": _indexed("cosine"), "index_l2": _indexed("l2"), "index_inner_product": _indexed("inner"), "index_chunks": index_chunks, "ward_cut": ward_cut}
QUERIES |= {f.__name__: f for f in (ann_budget, budget_strict, threshold_select, beam_two_level, cluster_inertia, similar_cache, early_termination)}

_V = "v AS (SELECT vec_id, label, [x::DOUBLE FOR x IN embedding] AS z FROM embeddings)"
_D = {
    "cosine": "1 - list_dot_product(a.z, b.z) / (sqrt(list_dot_product(a.z, a.z)) * sqrt(list_dot_product(b.z, b.z)))",
    "l1": "list_sum([abs(a.z[i] - b.z[i]) FOR i IN range(1, len(a.z) + 1)])",
    "l2": "sqrt(list_sum([(a.z[i] - b.z[i]) * (a.z[i] - b.z[i]) FOR i IN range(1, len(a.z) + 1)]))",
    "linf": "list_max([abs(a.z[i] - b.z[i]) FOR i IN range(1, len(a.z) + 1)])",
    "inner": "-list_dot_product(a.z, b.z)",
}


def _hits(metric, k=10):
    return f"SELECT * FROM (SELECT *, max(d) OVER (PARTITION BY query_id) AS far, row_number() OVER (PARTITION BY query_id ORDER BY d, node_id)::INTEGER AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS node_id, round({_D[metric]}, 9) AS d FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= {k}"


def _sql(metric):
    out = "round(-d, 6) + 0.0 AS score" if metric == "inner" else "round(d, 6) + 0.0 AS distance"
    return f"WITH {_V} SELECT query_id, rank, node_id, {out} FROM ({_hits(metric)})"


def _upto(metric, k):
    return f"SELECT *, node_id % 97 + 20 AS n_tokens, (sum(node_id % 97 + 20) OVER (PARTITION BY query_id ORDER BY rank))::BIGINT AS upto FROM ({_hits(metric, k)})"


_C = "c AS (SELECT label, list(x ORDER BY i) AS z FROM (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(1, len(z) + 1)) AS i, unnest(z) AS x FROM v) GROUP BY label, i) GROUP BY label)"
ORACLES = {
    **{f"knn_{name}": _sql(metric) for name, metric in (("cosine", "cosine"), ("l1", "l1"), ("l2", "l2"), ("linf", "linf"), ("inner_product", "inner"))},
    **{f"index_{name}": _sql(metric) for name, metric in (("cosine", "cosine"), ("l2", "l2"), ("inner_product", "inner"))},
    "ann_budget": f"WITH {_V} SELECT query_id, rank, node_id, upto FROM ({_upto('inner', 35)}) WHERE upto - n_tokens <= 3500",
    "budget_strict": f"WITH {_V} SELECT query_id, rank, node_id, upto FROM ({_upto('cosine', 10)}) WHERE upto <= 200",
    "threshold_select": f"WITH {_V} SELECT query_id, rank, node_id, CASE WHEN d <= 0.7 THEN 'within' ELSE 'reference' END AS sense FROM ({_hits('cosine')})",
    "beam_two_level": f"WITH {_V}, {_C}, t AS (SELECT a.vec_id AS query_id, -b.label - 1::BIGINT AS node_id, b.label, round({_D['cosine']}, 9) AS d FROM v a, c b WHERE a.vec_id % 20 = 0), tr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, node_id)::INTEGER AS rank FROM t), tt AS (SELECT * FROM tr WHERE rank <= 2), l AS (SELECT a.vec_id AS query_id, b.vec_id AS node_id, round({_D['cosine']}, 9) AS d FROM v a JOIN tt ON tt.query_id = a.vec_id JOIN v b ON b.label = tt.label WHERE b.vec_id <> a.vec_id), lr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, node_id)::INTEGER AS rank FROM l) SELECT query_id, 1 AS layer, rank, node_id, round(d, 6) + 0.0 AS d FROM tt UNION ALL SELECT query_id, 0, rank, node_id, round(d, 6) + 0.0 FROM lr WHERE rank <= 2",
    "cluster_inertia": f"WITH {_V}, {_C} SELECT a.label, count(*)::BIGINT AS n, round(sum(pow({_D['l2']}, 2)), 6) AS inertia FROM v a JOIN c b ON a.label = b.label GROUP BY a.label",
    "similar_cache": f"WITH {_V} SELECT query_id, entry_id, round(1 - d, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, entry_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS entry_id, round({_D['l2']}, 9) AS d FROM v a, v b WHERE a.vec_id % 20 = 0 AND b.vec_id % 20 <> 0 AND a.label % 2 = b.label % 2 AND 10000 - (5000 + b.vec_id % 3000) < 3600)) WHERE rank = 1 AND 1 - d > 0.2",
    "early_termination": f"""WITH RECURSIVE {_V}, h AS (SELECT query_id, rank, node_id, node_id % 97 + 20 AS n_tokens, 1 - d / far AS sure FROM ({_hits('cosine')})),
r AS (SELECT query_id, 0::BIGINT AS rank, 0::BIGINT AS node_id, 0::BIGINT AS upto, 0::DOUBLE AS sure FROM h WHERE rank = 1
  UNION ALL SELECT h.query_id, h.rank, h.node_id, r.upto + h.n_tokens, r.sure + h.sure FROM r JOIN h ON h.query_id = r.query_id AND h.rank = r.rank + 1
  WHERE NOT (r.upto + h.n_tokens > {BUDGET} AND (r.rank = 0 OR r.sure / greatest(r.rank, 1) > {SURE}::DOUBLE)))
SELECT query_id, rank::INTEGER AS rank, node_id, upto FROM r WHERE rank > 0""",
}
