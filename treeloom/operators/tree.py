"""Trees over texts and their vectors: cluster a layer, divide what is too long, summarise each cluster to a parent."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from treeloom.functions import text as T
from treeloom.functions.numbering import numbered
from treeloom.functions.vector import usable
from treeloom.operators import clusters as C
from treeloom.operators import mixtures as M
from treeloom.operators.chunking import Chunking, chunks, exploded
from treeloom.sources.scratch import Scratch
from treeloom.sources.trees import EDGES, BuildMetrics, Tree


@dataclass(frozen=True)
class TreeConfig:
    layers: int = 5
    dim: int = 10
    threshold: float = 0.1
    summary_tokens: int = 100
    max_tokens: int = 3500
    depth: int = 3
    least: float = 0.15
    adaptive: bool = True


def adjusted(level: DataFrame, config: TreeConfig) -> tuple[int, float]:
    """(dimension, threshold) that suit a layer's texts: longer texts get more dimensions, uneven ones a lower threshold."""
    r = level.agg(F.avg(F.length("text")).alias("mean"), F.max(F.length("text")).alias("high")).first()
    if not config.adaptive or not r["mean"]:
        return config.dim, config.threshold
    dim = min(config.dim + 2, 15) if r["mean"] > 500 else max(config.dim - 2, 5) if r["mean"] < 100 else config.dim
    return dim, config.threshold * 0.9 if r["high"] / r["mean"] > 3 else config.threshold


def leaves(chunks: DataFrame, *order: str) -> DataFrame:
    """(node_id, text, n_tokens, embedding) of chunks (text, n_tokens, embedding and the columns they are ordered by), numbered from 0."""
    return numbered(chunks.where("text IS NOT NULL"), "node_id", *order).select("node_id", "text", F.col("n_tokens").cast("long").alias("n_tokens"), F.col("embedding").cast("array<double>").alias("embedding"))


def _layer_clusters(level: DataFrame, n: int, dim: int, threshold: float, least: float, ws: Scratch) -> tuple[DataFrame, float | None, DataFrame | None]:
    """((node_id, cluster), silhouette, merges of Ward's method as of a group 0) of a layer: a mixture over the whole table, or for few nodes what suits their number."""
    whole = level.select(F.lit("0").alias("group"), "node_id", "embedding")
    if C.method(n) != "mixture":
        few = ws.save(C.group_clusters(whole, dim, threshold, least), "few")
        return few.select("node_id", "cluster"), few.agg(F.max("silhouette")).first()[0] or 0.0, None
    x = ws.save(M.reduced(level, n, dim), "reduced")
    model, _ = M.fit_table(x, n, min(n // 2, 10))
    found = ws.save(M.members(x, model, threshold), "members")
    # by squared distances, which is linear in the nodes
    hard = x.join(found.where("top").select("node_id", F.col("cluster").cast("double").alias("prediction")), "node_id").select("prediction", array_to_vector("x").alias("features"))
    score = ClusteringEvaluator().evaluate(hard) if len(model[0]) > 1 and hard.select("prediction").distinct().count() > 1 else 0.0
    if score >= least:
        return found.select("node_id", "cluster"), score, None
    # poor mixtures give way to Ward's method, even if that is no better
    found, merges = C.warded_merges(whole, min(n // 2, 5))
    found = ws.save(found, "ward")
    return found.select("node_id", "cluster"), found.agg(F.max("silhouette")).first()[0], merges


def _within(merges: DataFrame, rows: DataFrame) -> DataFrame:
    """The merges (group, lo, hi, height, step) of groups that lie inside one of their clusters (path, group, node_id), with the cluster as their group."""
    side = lambda c: rows.select("group", F.col("node_id").alias(c), F.col("path").alias(f"{c}_path"))
    both = merges.join(side("lo"), ["group", "lo"]).join(side("hi"), ["group", "hi"]).where("lo_path = hi_path")
    return both.select(F.col("lo_path").alias("group"), "lo", "hi", "height", "step")


def clustered(level: DataFrame, n: int, config: TreeConfig, ws: Scratch) -> DataFrame:
    """(path, node_id): a layer's clusters. Those of more than 3 nodes and too many tokens are clustered again, all at once, down to ``depth``.

    Ward's method goes over a node's group once: parts of a group it has clustered keep their merges.
    """
    dim, threshold = adjusted(level, config)
    found, score, merges = _layer_clusters(level, n, dim, threshold, config.least, ws)
    open_ = found.select(F.lit("0").alias("group"), F.col("cluster").cast("string").alias("path"), "node_id", F.lit(score).cast("double").alias("silhouette"))
    done = None
    for depth in range(1, config.depth):
        rows = ws.save(open_.join(level.select("node_id", "n_tokens"), "node_id"), f"clusters-{depth}")
        large = rows.groupBy("path").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"), F.max("silhouette").alias("s"))
        large = large.where((F.col("n") > 3) & (F.col("t") > config.max_tokens) & (F.coalesce("s", F.lit(1.0)) >= 0.1)).select("path")
        whole = rows.join(large, "path", "left_anti").select("path", "node_id")
        done = whole if done is None else done.unionByName(whole)
        again = rows.join(large, "path", "left_semi").join(level.select("node_id", "embedding"), "node_id")
        inside = None if merges is None else _within(merges, again)
        parts, merges = C.grouped(again.select(F.col("path").alias("group"), "node_id", "embedding"), dim, threshold, config.least, merges=inside)
        open_ = ws.save(parts.select("group", F.concat_ws(".", "group", F.col("cluster").cast("string")).alias("path"), "node_id", "silhouette"), f"parts-{depth}")
    rest = open_.select("path", "node_id")
    return ws.save(rest if done is None else done.unionByName(rest), "paths")


def summaries(members: DataFrame, limit: int) -> DataFrame:
    """(parent_id, text, n_tokens): the first sentences of a parent's members (parent_id, node_id, text), in order, up to a token limit.

    A sentence has a token at least, so no more members than the limit can count: the rank
    limit comes before the shuffle, and a task never holds more of a parent. In place of a remote model.
    """
    first = members.select("parent_id", "node_id", F.get(T.sentences(T.one_line(F.col("text"))), F.lit(0)).alias("s")).where("s IS NOT NULL").withColumn("n", T.token_count(F.col("s")))
    w = Window.partitionBy("parent_id").orderBy("node_id")
    first = first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    # the first sentence stays, however long
    first = first.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("upto") <= limit) | (F.col("rank") == 1))
    held = F.array_sort(F.collect_list(F.struct("rank", "s")))
    return first.groupBy("parent_id").agg(F.array_join(F.transform(held, lambda m: m["s"]), " ").alias("text"), F.sum("n").alias("n_tokens"))


def told(members: DataFrame, limit: int, summariser: Callable[[Column], Column], count: Callable[[Column], Column] = T.token_count) -> DataFrame:
    """(parent_id, text, n_tokens): what a plug-in makes of the members' texts (parent_id, node_id, text), in order, up to a token limit.

    The plug-in, an expression or an Arrow UDF from texts to texts, gets one text a parent; lines are
    joined by a space, with an empty line after each member. The limit is that of a model's input:
    members beyond it are left out, but for the first. Without text there is nothing to tell.
    """
    m = members.where(T.filled(F.col("text"))).select("parent_id", "node_id", T.one_line(F.col("text")).alias("s")).withColumn("n", F.greatest(count(F.col("s")), F.lit(1)))
    w = Window.partitionBy("parent_id").orderBy("node_id")
    m = m.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    m = m.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("upto") <= limit) | (F.col("rank") == 1))
    held = F.array_sort(F.collect_list(F.struct("rank", "s")))
    whole = m.groupBy("parent_id").agg(F.array_join(F.transform(held, lambda h: h["s"]), "\n\n").alias("whole"))
    return whole.select("parent_id", summariser(F.col("whole")).alias("text")).withColumn("n_tokens", count(F.col("text")).cast("long"))


def means(members: DataFrame) -> DataFrame:
    """(parent_id, embedding): the members' mean vector, of length 1 (a zero mean stays zero)."""
    cells = members.select("parent_id", F.posexplode("embedding").alias("i", "x")).groupBy("parent_id", "i").agg(F.avg("x").alias("x"))
    m = cells.groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("m")).select("parent_id", F.expr("transform(m, p -> p.x)").alias("m"))
    size = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x))
    return m.select("parent_id", F.transform("m", lambda x: x / F.greatest(size, F.lit(1e-12))).alias("embedding"))


@dataclass(frozen=True)
class Plugins:
    """What a build takes from outside; all have stand-ins.

    ``summariser`` and ``embedder`` are from a column of texts to one of texts or vectors, ``tokenizer``
    to one of counts (an expression, as it stands inside arrays too). ``clusters`` gives (path, node_id) of
    a layer from (level, its number of nodes, configuration, scratch folder); a node may have several
    paths. ``progress`` gets a ``Progress`` after each layer.
    """

    summariser: Callable[[Column], Column] | None = None
    embedder: Callable[[Column], Column] | None = None
    tokenizer: Callable[[Column], Column] = T.token_count
    clusters: Callable[[DataFrame, int, TreeConfig, Scratch], DataFrame] = clustered
    progress: Callable[[Progress], None] | None = None


@dataclass(frozen=True)
class Progress:
    """A finished layer: its nodes, their tokens and links to the layer below, and seconds since the build began."""

    layer: int
    nodes: int
    tokens: int
    links: int
    seconds: float


def build(nodes: DataFrame, config: TreeConfig = TreeConfig(), plugins: Plugins = Plugins()) -> tuple[Tree, BuildMetrics]:
    """The tree over leaves (node_id, text, n_tokens, embedding), and what its building took.

    Layers end at ``dim`` + 1 nodes or fewer, or where clusters would be no fewer than nodes.
    A node may have several parents. Parents are numbered on from the highest node, in order of
    their clusters, and clusters of the same members are one. Each layer is a written table.
    Leaves without id or usable vector are left out; a null text is empty. Parents get the vectors of
    their texts from the plug-in's embedder, or without one (or if it gives none) their members' mean.
    Progress is observed as the layer is written, without a second scan.
    """
    began = time.time()
    spark = nodes.sparkSession
    ws = Scratch(spark, "tree")
    fine = nodes.where(F.col("node_id").isNotNull() & usable(F.col("embedding")))
    level = ws.save(fine.select(F.col("node_id").cast("long").alias("node_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"), F.col("embedding").cast("array<double>").alias("embedding")), "layer-0")
    all_, edges = level.withColumn("layer", F.lit(0)), spark.createDataFrame([], EDGES)
    total, high = level.agg(F.count("*"), F.max("node_id")).first()
    n, made, built = total, total, 0
    for layer in range(1, config.layers + 1):
        if n <= config.dim + 1:
            break
        paths = plugins.clusters(level, n, config, ws)
        # clusters by what they hold: two sums of hashes and the count tell member sets apart
        same = paths.groupBy("path").agg(F.count("*").alias("k"), F.sum(F.xxhash64("node_id").cast("decimal(38,0)")).alias("a"), F.sum(F.hash("node_id").cast("long")).alias("b"))
        names = numbered(same.groupBy("k", "a", "b").agg(F.min("path").alias("path")).select("path"), "parent_id", "path", start=high + 1)
        parents = names.count()
        if parents >= n:
            break
        links, whole = Observation(), Observation()
        link = paths.join(names, "path").select("parent_id", F.col("node_id").alias("child_id"))
        link = ws.save(link.observe(links, F.count("*").alias("n")), "links")
        member = link.withColumnRenamed("child_id", "node_id").join(level, "node_id")
        said = member.select("parent_id", "node_id", "text")
        texts = told(said, config.max_tokens, plugins.summariser, plugins.tokenizer) if plugins.summariser else summaries(said, config.summary_tokens)
        level = means(member.select("parent_id", "embedding")).join(texts, "parent_id", "left")
        level = level.select(F.col("parent_id").alias("node_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "embedding")
        if plugins.embedder:
            # written first, as an Arrow UDF would else run anew in each branch
            level = ws.save(level, f"told-{layer}").withColumn("new", plugins.embedder(F.col("text")).cast("array<double>"))
            level = level.withColumn("embedding", F.when(usable(F.col("new")), F.col("new")).otherwise(F.col("embedding"))).drop("new")
        level = ws.save(level.observe(whole, F.count("*").alias("n"), F.sum("n_tokens").alias("tokens")), f"layer-{layer}")
        if plugins.progress:
            plugins.progress(Progress(layer, whole.get["n"], whole.get["tokens"] or 0, links.get["n"], time.time() - began))
        all_, edges = all_.unionByName(level.withColumn("layer", F.lit(layer))), edges.unionByName(link)
        n, high, made, built = parents, high + parents, made + parents, layer
    return Tree(all_.select("node_id", "layer", "text", "n_tokens", "embedding"), edges), BuildMetrics(time.time() - began, total, made, built)


def from_documents(docs: DataFrame, config: TreeConfig = TreeConfig(), chunking: Chunking = Chunking(), plugins: Plugins = Plugins()) -> tuple[Tree, BuildMetrics]:
    """The tree over whole documents (doc_id, text): chunks, their vectors, leaves in order of document and place, layers.

    Without an embedder, vectors are letter shares.
    """
    ws = Scratch(docs.sparkSession, "leaves")
    embed = plugins.embedder or T.letter_vector
    cut = ws.save(exploded(chunks(docs.select("doc_id", "text"), chunking, count=plugins.tokenizer), "doc_id"), "chunks")
    vectors = ws.save(cut.withColumn("embedding", embed(F.col("text"))), "vectors")
    return build(ws.save(leaves(vectors, "doc_id", "pos"), "leaves"), config, plugins)
