"""Nearest neighbours, token budgets, and descent through layers.

Neighbours are found block by block: vectors are packed into matrices, the blocks of the
queries that a caller states meet the blocks of nodes, and a task keeps the k nearest of
each of its queries before anything is shuffled. An Arrow batch holds few pairs of blocks (``bounded_batches``).

Cases: vectors that are null, empty or hold null or non-finite components take no part; only
vectors of one length meet; a zero vector is at cosine distance 1; a query is no neighbour of
the node with its id; queries that share an id are one (the least vector); equal distances (to nine digits) go to the smaller node_id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions.vector import usable
from treeloom.sources.scratch import bounded_batches

METRICS = ("cosine", "l1", "l2", "linf", "inner")
#: Vectors of a block.
BLOCK = 2048
#: Tasks that pack the vectors of one kind.
SALTS = 8


def _blocks(block: int):
    """Packs (id, kind, vec) into (dim, kind, name, ids, data): matrices of doubles of one length and kind."""

    def run(batches):
        held: dict[tuple, list] = {}

        def out(key):
            ids, rows = (np.concatenate(x) for x in zip(*held.pop(key)))
            names = np.frombuffer(hashlib.blake2b(ids.tobytes(), digest_size=8).digest(), np.int64)
            columns = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array(names), pa.array([ids.tobytes()], pa.binary()), pa.array([rows.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["dim", "kind", "name", "ids", "data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.diff(batch["vec"].offsets.to_numpy()), batch["kind"].to_numpy()], 1)
            order = np.lexsort(keys.T)
            keys, batch = keys[order], batch.take(pa.array(order))
            starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
            for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
                key, own = tuple(keys[at].tolist()), batch.slice(at, end - at)
                x = own["vec"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, key[0])
                held.setdefault(key, []).append((own["id"].to_numpy(), x))
                if sum(len(i) for i, _ in held[key]) >= block:
                    yield out(key)
            # of many kinds those that come no more: where rows are ordered by kind, all but the last
            if len(held) > 1 and sum(len(i) for parts in held.values() for i, _ in parts) >= 8 * block:
                for key in [k for k in held if k[1] != int(keys[-1, 1])]:
                    yield out(key)
        for key in list(held):
            yield out(key)

    return run


def _distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "inner":
        return -(q @ x.T)
    if metric == "cosine":
        size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        return np.where(size > 0, 1 - (q @ x.T) / np.where(size > 0, size, 1), 1.0)
    fold = {"l1": lambda d: np.abs(d).sum(1), "l2": lambda d: np.sqrt((d * d).sum(1)), "linf": lambda d: np.abs(d).max(1)}[metric]
    return np.stack([fold(x - row) for row in q])


def _nearest(k: int, metric: str):
    """The k nearest of each query among the blocks of nodes that its block meets in a task, and its farthest distance."""

    def run(batches):
        now, best, far = None, [], None

        def out():
            rows = [(q, n, d, f) for q, (ds, ns), f in zip(now[1].tolist(), best, far.tolist()) for d, n in zip(ds.tolist(), ns.tolist())]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 4, kinds)], names=["query_id", "node_id", "d", "far"])

        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch["ids"][i].as_buffer(), np.int64)
                x = np.frombuffer(batch["data"][i].as_buffer(), np.float64).reshape(len(ids), -1)
                q_ids = np.frombuffer(batch["q_ids"][i].as_buffer(), np.int64)
                q = np.frombuffer(batch["q_data"][i].as_buffer(), np.float64).reshape(len(q_ids), -1)
                name = batch["q_name"][i].as_py(), x.shape[1]
                if now is None or now[0] != name:
                    if now is not None:
                        yield out()
                    now, best, far = (name, q_ids.copy()), [(np.zeros(0), np.zeros(0, np.int64))] * len(q_ids), np.full(len(q_ids), -np.inf)
                d = np.round(_distances(q, x, metric), 9)
                for j, own in enumerate(q_ids):
                    row, names = d[j], ids
                    if (names == own).any():
                        row, names = row[names != own], names[names != own]
                    if not len(row):
                        continue
                    far[j] = max(far[j], row.max())
                    if len(row) > k:  # whatever equals the kth stays
                        near = row <= np.partition(row, k - 1)[k - 1]
                        row, names = row[near], names[near]
                    row, names = np.concatenate([best[j][0], row]), np.concatenate([best[j][1], names])
                    order = np.lexsort((names, row))[:k]
                    best[j] = row[order], names[order]
        if now is not None:
            yield out()

    return run


def _met(queries: DataFrame, nodes: DataFrame, block: int) -> DataFrame:
    """Blocks of queries (id, kind, vec) beside blocks of nodes of their length and kind: (ids, data, q_name, q_ids, q_data).

    Blocks of nodes are dealt to as many groups as there are cores; every block of queries goes
    to each group under a join key of its own.
    """
    bounded_batches(nodes.sparkSession)
    packed = "dim int, kind long, name long, ids binary, data binary"
    q = queries.mapInArrow(_blocks(block // 4), packed).select("dim", "kind", F.col("name").alias("q_name"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    groups = F.lit(max(1, nodes.sparkSession.sparkContext.defaultParallelism)).cast("long")
    n = nodes.mapInArrow(_blocks(block), packed).withColumn("part", F.pmod(F.xxhash64("ids"), groups))
    q = q.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), groups - 1)))
    return n.join(q, ["dim", "kind", "part"]).sortWithinPartitions("dim", "kind", "q_name", "part").select("ids", "data", "q_name", "q_ids", "q_data")


def _plain(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Plain distances from one product of matrices; those so short that the product's error shows are taken from differences."""
    qq, xx = (q * q).sum(1), (x * x).sum(1)
    d = np.column_stack([q, qq, np.ones(len(q))]) @ np.column_stack([-2 * x, np.ones(len(x)), xx]).T
    near = np.flatnonzero(d <= 1e-9 * (qq.max(initial=0) + xx.max(initial=0)))
    for at in range(0, len(near), 8192):
        row, col = np.divmod(near[at : at + 8192], len(x))
        gap = q[row] - x[col]
        d[row, col] = np.einsum("ij,ij->i", gap, gap)
    return np.sqrt(d, out=d)


def _label_sums(batches):
    """For each block of queries that a task meets, sums and numbers by label; only one block's are held."""
    now, total = None, {}

    def out():
        rows = [(now[1], np.full(len(now[1]), label), s, np.full(len(s), n)) for label, (s, n) in total.items()]
        total.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=["row", "label", "s", "n"])

    for batch in batches:
        for i in range(batch.num_rows):
            labels = np.frombuffer(batch["ids"][i].as_buffer(), np.int64)
            q_ids = np.frombuffer(batch["q_ids"][i].as_buffer(), np.int64)
            x, q = (np.frombuffer(batch[c][i].as_buffer(), np.float64).reshape(n, -1) for c, n in (("data", len(labels)), ("q_data", len(q_ids))))
            name = batch["q_name"][i].as_py(), x.shape[1]
            if now is None or now[0] != name:
                if total:
                    yield out()
                now = name, q_ids.copy()
            order = np.argsort(labels, kind="stable")
            own, starts, counts = np.unique(labels[order], return_index=True, return_counts=True)
            sums = np.add.reduceat(_plain(q, x[order]), starts, axis=1)
            for label, s, n in zip(own.tolist(), sums.T, counts.tolist()):
                held = total.get(label, (0.0, 0))
                total[label] = held[0] + s, held[1] + n
    if total:
        yield out()


def label_distances(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, label, s, n): for each row of (row, embedding, label) the sum of its plain distances to the rows of a label, and their number."""
    met = _met(*(points.select(F.col(c).alias("id"), F.lit(0).cast("long").alias("kind"), F.col("embedding").alias("vec")) for c in ("row", "label")), block)
    return met.mapInArrow(_label_sums, "row long, label long, s double, n long").groupBy("row", "label").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def _found(queries: DataFrame, nodes: DataFrame, k: int, metric: str, block: int, by: str | None) -> DataFrame:
    """(query_id, node_id, d, far): the k nearest of each query in each task, for each of its values of ``by``."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    kind = (F.xxhash64(by) if by else F.lit(0).cast("long")).alias("kind")
    fine = lambda df, i, v: df.select(F.col(i).cast("long").alias("id"), kind, F.col(v).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    q = fine(queries, "query_id", "q").groupBy("id", "kind").agg(F.min("vec").alias("vec"))
    n = fine(nodes, "node_id", "embedding")
    if by:  # rows of a kind together, so that blocks of many kinds are few; a frequent one in several tasks
        q, n = (x.repartition("kind", F.pmod(F.xxhash64("id"), F.lit(SALTS))).sortWithinPartitions("kind") for x in (q, n))
    return _met(q, n, block).mapInArrow(_nearest(k, metric), "query_id long, node_id long, d double, far double")


def nearest(queries: DataFrame, nodes: DataFrame, k: int = 10, metric: str = "cosine", block: int = BLOCK, by: str | None = None) -> DataFrame:
    """(query_id, rank, node_id, d, far) of queries (query_id, q) among nodes (node_id, embedding); far is the query's largest distance.

    With ``by``, a column of both, only nodes of the query's own value (by its 64-bit hash) are compared.
    """
    own = Window.partitionBy("query_id")
    hits = _found(queries, nodes, k, metric, block, by)
    hits = hits.withColumn("far", F.max("far").over(own)).withColumn("rank", F.row_number().over(own.orderBy("d", "node_id")))
    return hits.where(F.col("rank") <= k).select("query_id", "rank", "node_id", "d", "far")


def knn(queries: DataFrame, nodes: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """(query_id, rank, node_id, distance), nearest first; by inner product (query_id, rank, node_id, score), largest first."""
    hits = nearest(queries, nodes, k, metric)
    if metric == "inner":
        return hits.select("query_id", "rank", "node_id", (F.round(-F.col("d"), 6) + 0.0).alias("score"))
    return hits.select("query_id", "rank", "node_id", (F.round("d", 6) + 0.0).alias("distance"))


def within_budget(hits: DataFrame, budget: int, mode: str = "prefix") -> DataFrame:
    """Hits (query_id, rank, n_tokens) up to a token budget; ``inclusive`` keeps the one that overshoots."""
    upto = F.sum("n_tokens").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    out = hits.withColumn("upto", upto)
    if mode == "prefix":
        return out.where(F.col("upto") <= budget)
    if mode == "inclusive":
        return out.where(F.col("upto") - F.col("n_tokens") <= budget)
    raise ValueError(f"unknown mode: {mode}")


def select(hits: DataFrame, mode: str = "top_k", k: int = 10, threshold: float = 0.5, sense: str = "reference") -> DataFrame:
    """Of ranked hits (rank, d) the first k, or by threshold: ``reference`` keeps what is farther than it, ``within`` what is no farther."""
    if mode == "top_k":
        return hits.where(F.col("rank") <= k)
    if mode == "threshold" and sense in ("reference", "within"):
        return hits.where(F.col("d") > threshold) if sense == "reference" else hits.where(F.col("d") <= threshold)
    raise ValueError(f"unknown mode: {mode} {sense}")


def beam(queries: DataFrame, top: DataFrame, layers: list[DataFrame], edges: DataFrame, k: int) -> DataFrame:
    """(query_id, layer, rank, node_id, d): the k nearest of the top layer, then of their children, and so on.

    ``top`` and ``layers`` (the lower ones, highest first) hold (node_id, embedding); ``edges`` hold (parent_id,
    child_id). A child of two parents counts once. Queries without children end there.
    """
    found = nearest(queries, top, k).select("query_id", F.lit(len(layers)).alias("layer"), "rank", "node_id", "d")
    hits = found
    for depth, nodes in enumerate(layers):
        reach = hits.select("query_id", F.col("node_id").alias("parent_id"))
        below = edges.join(reach.select("parent_id").distinct(), "parent_id", "left_semi").select("parent_id", F.col("child_id").alias("node_id")).distinct()
        # blocks of a parent's queries meet blocks of its children; the k nearest of all are among the k nearest of each parent
        near = _found(reach.join(queries, "query_id"), below.join(nodes, "node_id"), k, "cosine", BLOCK, "parent_id")
        near = near.groupBy("query_id", "node_id").agg(F.min("d").alias("d"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "node_id"))
        hits = near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.lit(len(layers) - 1 - depth).alias("layer"), "rank", "node_id", "d")
        found = found.unionByName(hits)
    return found


def ends_early(hits: DataFrame, budget: int, sure: float = 0.8) -> DataFrame:
    """(query_id, rank, node_id, upto) of hits (query_id, rank, node_id, d, n_tokens, far) that a reader takes.

    A hit's confidence is 1 minus its distance's part of the query's largest. A hit that would
    pass the budget ends the list if it is the first, or if the mean confidence of those before
    it is over ``sure``; else it is taken too. A query's hits are its k nearest, so the array folded is bounded by k.
    """
    near = F.array_sort(F.collect_list(F.struct("rank", "node_id", F.col("n_tokens").cast("long").alias("n_tokens"), (1 - F.when(F.col("far") > 0, F.col("d") / F.col("far")).otherwise(0.0)).alias("sure"))))
    kind = "struct<upto:bigint,sure:double,over:boolean,taken:array<struct<rank:int,node_id:bigint,upto:bigint>>>"
    start = F.expr(f"cast(struct(0, 0.0, false, array()) as {kind})")

    def step(a, h):
        upto, n = a["upto"] + h["n_tokens"], F.size(a["taken"])
        ends = a["over"] | ((upto > budget) & ((n == 0) | (a["sure"] / F.greatest(n, F.lit(1)) > sure)))
        taken = F.concat(a["taken"], F.array(F.struct(h["rank"].alias("rank"), h["node_id"].alias("node_id"), upto.alias("upto"))))
        more = F.struct(upto.alias("upto"), (a["sure"] + h["sure"]).alias("sure"), F.lit(False).alias("over"), taken.alias("taken")).cast(kind)
        return F.when(ends, F.struct(a["upto"].alias("upto"), a["sure"].alias("sure"), F.lit(True).alias("over"), a["taken"].alias("taken")).cast(kind)).otherwise(more)

    rows = hits.groupBy("query_id").agg(near.alias("h")).select("query_id", F.explode(F.aggregate("h", start, step, lambda a: a["taken"])).alias("t"))
    return rows.select("query_id", "t.rank", "t.node_id", "t.upto")
