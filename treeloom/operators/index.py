"""A saved index over vectors: an inverted file by coarse cell, searched exactly by stop bounds.

Vectors lie in the cell of their nearest centre. Inside a cell they are blocks ordered by
distance to the centre, so each block is a ring of known radii. A search reads the cells nearest to
a query first, which bounds its kth distance; then only cells and rings that can hold something as near, by the
triangle inequality. Results are those of a full scan. Without the second step they are those of the nearest cells.

On disk: ``cells`` (Parquet, a folder for each cell), ``centres``, ``texts`` (if given) and ``facts``, which is
written last and vouches for the others. Centres are bounded in number and bytes, so they go to every task. A cell
of any size is many blocks and files; a cell that many queries ask for is met by blocks of queries.

Cases: vectors that are null, empty, not finite, of another length than most, or without an id are left out; a zero vector
is at cosine distance 1; a query is no neighbour of the node with its id; equal distances (to nine
digits) go to the smaller node_id; nodes that share an id are a row each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeloom.functions.vector import usable
from treeloom.operators import chunking as C
from treeloom.operators.tree import leaves
from treeloom.sources.scratch import Scratch, exists
from treeloom.sources.trees import Tree

METRICS = ("cosine", "l2", "inner")
#: Cells at most, bytes of all centres at most, and rows for each cell that the centres are fitted on.
CELLS, CENTRE_BYTES, SAMPLE = 4096, 64 << 20, 64
#: Vectors of a block, and of the part of a cell that one task packs.
BLOCK, PART = 1024, 100_000
#: Numbers of a matrix of rows by centres that a Python task holds at a time, however many centres there are.
MATRIX = 1 << 18
SEED, SLACK = 224, 1e-8

_CELLS = "dim int, ids binary, data binary, near double, far double, n long, cell int"


def _prepared(x: np.ndarray, metric: str) -> np.ndarray:
    """Vectors as the cells see them: for cosine of length 1 (zero ones stay)."""
    if metric != "cosine":
        return x
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def _distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Of prepared vectors."""
    if metric == "inner":
        return -(q @ x.T)
    if metric == "cosine":
        return 1 - q @ x.T
    return np.sqrt(np.stack([((x - r) ** 2).sum(1) for r in q]))


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Plain distances to the centres."""
    square = (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * (x @ centres.T)
    return np.sqrt(np.maximum(square, 0))


def _least(gap: np.ndarray, near: np.ndarray, far: np.ndarray, along: np.ndarray, size: np.ndarray, metric: str) -> np.ndarray:
    """The least distance that a vector of a ring [near, far] can have from a query ``gap`` away from the ring's centre.

    ``along`` is the query's inner product with the centre, ``size`` its length.
    """
    if metric == "inner":
        return -(along + size * far)
    apart = np.maximum(0, np.maximum(gap - far, near - gap))
    return apart * apart / 2 if metric == "cosine" else apart


def _rows(batch, name: str) -> np.ndarray:
    return batch[name].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def _parts(batches, centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a matrix of their rows by the centres is bounded."""
    step = max(1, MATRIX // max(len(centres), 1))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _placed(centres: np.ndarray, metric: str):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _prepared(_rows(batch, "vec"), metric)
                step = max(1, MATRIX // max(len(centres), 1))
                cell = np.concatenate([_gaps(x[at : at + step], centres).argmin(1) for at in range(0, len(x), step)])
                gap = np.sqrt(((x - centres[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(list(x), pa.list_(pa.float64())), pa.array(cell.astype(np.int32)), pa.array(gap)], names=["id", "vec", "cell", "gap"])

    return run


def _packed(batches):
    """Blocks of rows that come ordered by cell, part and gap."""
    held, now = [], None

    def out():
        ids, gaps, vectors = zip(*held)
        m = np.array(vectors)
        row = {"dim": pa.array([m.shape[1]], pa.int32()), "ids": [np.array(ids, np.int64).tobytes()], "data": [m.tobytes()], "near": [min(gaps)], "far": [max(gaps)], "n": pa.array([len(ids)], pa.int64()), "cell": pa.array([now[0]], pa.int32())}
        held.clear()
        return pa.RecordBatch.from_pydict(row)

    for batch in batches:
        vectors = _rows(batch, "vec") if batch.num_rows else []
        for i, cell, part, gap, v in zip(*(batch[c].to_pylist() for c in ("id", "cell", "part", "gap")), vectors):
            if held and ((cell, part) != now or len(held) >= BLOCK):
                yield out()
            now = cell, part
            held.append((i, gap, v))
    if held:
        yield out()


def _nearest_cells(centres: np.ndarray, metric: str, probes: int):
    """The cells that each query asks for first: those of the nearest centres."""

    def run(batches):
        for batch in _parts(batches, centres):
            x = _prepared(_rows(batch, "vec"), metric)
            key = -(x @ centres.T) if metric == "inner" else _gaps(x, centres)
            cells = np.argsort(key, axis=1, kind="stable")[:, :probes].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(list(x), pa.list_(pa.float64())), pa.array(list(cells), pa.list_(pa.int32()))], names=["id", "vec", "cells"])

    return run


def _other_cells(centres: np.ndarray, near: np.ndarray, far: np.ndarray, metric: str):
    """The cells beyond a query's first ones that can hold something no farther than ``kth``."""

    def run(batches):
        for batch in _parts(batches, centres):
            x, kth = _rows(batch, "vec"), batch["kth"].to_numpy(zero_copy_only=False)
            low = _least(_gaps(x, centres), near, far, x @ centres.T, np.linalg.norm(x, axis=1)[:, None], metric)
            may = (low <= kth[:, None] + SLACK) & np.isfinite(far)[None]
            for i, cells in enumerate(batch["cells"].to_pylist()):
                may[i, cells] = False
            out = [np.flatnonzero(r).astype(np.int32) for r in may]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["vec"], batch["kth"], pa.array(out, pa.list_(pa.int32()))], names=["id", "vec", "kth", "cells"])

    return run


def _query_blocks(block: int):
    """Packs (cell, id, kth, vec), which come ordered by cell, into a row for each block of queries of a cell."""

    def run(batches):
        held, now = [], None

        def out():
            ids, kth, vectors = zip(*held)
            held.clear()
            return pa.RecordBatch.from_pydict({"cell": pa.array([now], pa.int32()), "q_ids": [np.array(ids, np.int64).tobytes()], "q_kth": [np.array(kth, float).tobytes()], "q_data": [np.array(vectors).tobytes()]})

        for batch in batches:
            vectors = _rows(batch, "vec") if batch.num_rows else []
            for cell, i, kth, v in zip(*(batch[c].to_pylist() for c in ("cell", "id", "kth")), vectors):
                if held and (cell != now or len(held) >= block):
                    yield out()
                now = cell
                held.append((i, kth, v))
        if held:
            yield out()

    return run


def _searched(centres: np.ndarray, k: int, metric: str, held: int = 20_000):
    """The k nearest of each query in the blocks that its block meets, as far as the bounds let them be read."""

    def run(batches):
        best: dict[int, tuple] = {}

        def out():
            ds, ns = (np.concatenate(c) for c in zip(*best.values()))
            asked = np.repeat(np.fromiter(best, np.int64, len(best)), [len(d) for d, _ in best.values()])
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array(asked), pa.array(ns), pa.array(ds)], names=["query_id", "node_id", "d"])

        for batch in batches:
            for i in range(batch.num_rows):
                g = lambda c, i=i: batch[c][i].as_py()
                b = lambda c, t, i=i: np.frombuffer(batch[c][i].as_buffer(), t)
                dim, c = g("dim"), centres[g("cell")]
                ids, q_ids, kth = b("ids", np.int64), b("q_ids", np.int64), b("q_kth", np.float64)
                q = b("q_data", np.float64).reshape(-1, dim)
                low = _least(_gaps(q, c[None])[:, 0], g("near"), g("far"), q @ c, np.linalg.norm(q, axis=1), metric)
                take = low <= kth + SLACK
                if not take.any():
                    continue
                x = b("data", np.float64).reshape(-1, dim)
                for query, most, row in zip(q_ids[take].tolist(), kth[take].tolist(), np.round(_distances(q[take], x, metric), 9)):
                    row, names = row[row <= most], ids[row <= most]  # what is farther than the kth so far is none of the k nearest
                    if (names == query).any():
                        row, names = row[names != query], names[names != query]
                    if not len(row):
                        continue
                    ds, ns = best.get(query, (np.zeros(0), np.zeros(0, np.int64)))
                    if len(row) > k:  # whatever equals the kth stays
                        near = row <= np.partition(row, k - 1)[k - 1]
                        row, names = row[near], names[near]
                    row, names = np.concatenate([ds, row]), np.concatenate([ns, names])
                    order = np.lexsort((names, row))[:k]
                    best[query] = row[order], names[order]
                if len(best) > held:
                    yield out()
        if best:
            yield out()

    return run


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    metric: str
    dim: int
    centres: np.ndarray

    @property
    def cells(self) -> DataFrame:
        return self.spark.read.schema(_CELLS).parquet(f"{self.path}/cells")

    @property
    def texts(self) -> DataFrame:
        """(node_id, text, n_tokens) of what is indexed, if it came with texts."""
        return self.spark.read.parquet(f"{self.path}/texts")

    def stats(self) -> DataFrame:
        """(cell, n, blocks, near, far) of each cell that holds vectors."""
        return self.cells.groupBy("cell").agg(F.sum("n").alias("n"), F.count("*").alias("blocks"), F.min("near").alias("near"), F.max("far").alias("far"))

    def vectors(self) -> DataFrame:
        """(node_id, embedding) as they are searched: for cosine of length 1."""

        def run(batches):
            for batch in batches:
                for dim, ids, data in zip(batch["dim"].to_pylist(), batch["ids"], batch["data"]):
                    m = np.frombuffer(data.as_py(), np.float64).reshape(-1, dim)
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids.as_py(), np.int64)), pa.array(list(m), pa.list_(pa.float64()))], names=["node_id", "embedding"])

        return self.cells.select("dim", "ids", "data").mapInArrow(run, "node_id long, embedding array<double>")

    def _add(self, placed: DataFrame, mode: str) -> None:
        """Writes (id, vec, cell, gap): each cell in parts, each part in blocks from the inner to the outer ring."""
        sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / PART).alias("parts"))  # one row for each cell
        rows = placed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id", "gap"), F.col("parts"))).drop("parts")
        rows = rows.repartition("cell", "part").sortWithinPartitions("cell", "part", "gap", "id")
        rows.mapInArrow(_packed, _CELLS).write.mode(mode).partitionBy("cell").parquet(f"{self.path}/cells")

    def add(self, nodes: DataFrame) -> None:
        """Adds nodes (node_id, embedding, perhaps text and n_tokens) to the cells that are there."""
        ws = Scratch(self.spark, "index")
        v = _usable(nodes).where(F.size("vec") == self.dim)
        self._add(ws.save(v.mapInArrow(_placed(self.centres, self.metric), "id long, vec array<double>, cell int, gap double"), "placed"), "append")
        if exists(self.spark, f"{self.path}/texts"):
            _texts(nodes).write.mode("append").parquet(f"{self.path}/texts")

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, exact: bool = True, block: int = 256) -> DataFrame:
        """(query_id, rank, node_id, d, cells) of queries (query_id, q); ``cells`` is how many cells were read for the query.

        Queries that share an id are one (the least vector). Distances are as ``retrieval.nearest`` has them: by inner product its negative.
        """
        ws = Scratch(self.spark, "search")
        q = queries.select(F.col("query_id").cast("long").alias("id"), F.col("q").cast("array<double>").alias("vec"))
        q = q.where(F.col("id").isNotNull() & usable(F.col("vec"))).where(F.size("vec") == self.dim).groupBy("id").agg(F.min("vec").alias("vec"))
        filled = {r["cell"]: r for r in self.stats().collect()}  # as many as cells
        known = np.array(sorted(filled), int)
        # only cells that hold something are asked for
        first = ws.save(q.mapInArrow(_nearest_cells(self.centres[known], self.metric, probes), "id long, vec array<double>, cells array<int>"), "first") if len(known) else None
        if first is None:
            return self.spark.createDataFrame([], "query_id long, rank int, node_id long, d double, cells long")
        names = F.array(*(F.lit(int(c)) for c in known))
        one = first.select("id", "vec", F.transform("cells", lambda i: F.get(names, i)).alias("cells"), F.lit(float("inf")).alias("kth"))
        hits, asked = self._read(one, k, block, ws, "near")
        if exact and len(known) > probes:
            near, far = np.full(len(self.centres), np.inf), np.full(len(self.centres), -np.inf)
            for c, r in filled.items():
                near[c], far[c] = r["near"], r["far"]
            bound = hits.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("d")).alias("kth"))
            rest = one.drop("kth").join(bound.withColumnRenamed("query_id", "id"), "id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("inf"))))
            rest = ws.save(rest.mapInArrow(_other_cells(self.centres, near, far, self.metric), "id long, vec array<double>, kth double, cells array<int>"), "rest")
            more, also = self._read(rest, k, block, ws, "far")
            hits, asked = _best(hits.unionByName(more), k), asked.unionByName(also).groupBy("query_id").agg(F.sum("cells").alias("cells"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "node_id"))
        return hits.withColumn("rank", rank).join(asked, "query_id").select("query_id", "rank", "node_id", "d", "cells")

    def _read(self, asked: DataFrame, k: int, block: int, ws: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
        """(hits, cells of each query) of queries (id, vec, kth, cells)."""
        pairs = asked.select("id", "vec", "kth", F.explode("cells").alias("cell"))
        wanted = [r["cell"] for r in pairs.select("cell").distinct().collect()]  # no more than cells; other folders aren't read
        packed = pairs.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("cell", "id").mapInArrow(_query_blocks(block), "cell int, q_ids binary, q_kth binary, q_data binary")
        met = self.cells.where(F.col("cell").isin(wanted)).join(ws.save(packed, f"{name}-queries"), "cell")
        found = met.mapInArrow(_searched(self.centres, k, self.metric), "query_id long, node_id long, d double")
        return ws.save(_best(found, k), f"{name}-hits"), asked.select(F.col("id").alias("query_id"), F.size("cells").cast("long").alias("cells"))

    def check(self, embed: Callable[[Column], Column], n: int = 4, tolerance: float = 1e-5) -> DataFrame:
        """(node_id, gap, holds) of n indexed texts, by a hash of their ids: whether embedding them again gives the vectors that are indexed."""
        some = self.texts.where("text IS NOT NULL").orderBy(F.xxhash64("node_id"), "node_id").limit(n).select("node_id", embed(F.col("text")).cast("array<double>").alias("again"))
        length = F.sqrt(F.aggregate("again", F.lit(0.0), lambda s, x: s + x * x))
        again = F.when((length > 0) & F.lit(self.metric == "cosine"), F.transform("again", lambda x: x / length)).otherwise(F.col("again"))
        both = some.withColumn("again", again).join(self.vectors(), "node_id")
        gap = F.array_max(F.zip_with("again", "embedding", lambda a, b: F.abs(a - b)))
        return both.select("node_id", gap.alias("gap"), F.coalesce(gap <= tolerance, F.lit(False)).alias("holds"))


def _usable(nodes: DataFrame) -> DataFrame:
    v = nodes.select(F.col("node_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return v.where(F.col("id").isNotNull() & usable(F.col("vec")))


def _texts(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("node_id").cast("long").alias("node_id"), "text", F.col("n_tokens").cast("long").alias("n_tokens"))


def _best(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "node_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def build(nodes: DataFrame, path: str, metric: str = "cosine", cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """An index over nodes (node_id, embedding, perhaps text and n_tokens), saved under ``path``, which must be free.

    There are as many cells as the root of the number of vectors, within bounds. Centres are fitted on about ``sample`` vectors for each
    cell, by a hash; every vector is indexed, whatever they are.
    """
    spark = nodes.sparkSession
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    if exists(spark, path):
        raise ValueError(f"something is at {path}")
    ws = Scratch(spark, "index")
    v = ws.save(_usable(nodes), "vectors")
    lengths = {r["dim"]: r["n"] for r in v.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).collect()}
    dim = max(lengths, key=lambda d: (lengths[d], -d), default=0)
    n, v = lengths.get(dim, 0), v.where(F.size("vec") == dim)
    cells = max(1, min(cells or round(n**0.5), CELLS, CENTRE_BYTES // max(8 * dim, 1)))
    centres = np.zeros((1, dim))
    if n and cells > 1:
        share = min(1.0, sample * cells / n)
        some = v.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30) < share)
        length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
        x = F.when((length > 0) & F.lit(metric == "cosine"), F.transform("vec", lambda c: c / length)).otherwise(F.col("vec"))
        some = ws.save(some.select(x.alias("x")), "sample").select(array_to_vector("x").alias("features"))
        if not some.isEmpty():
            centres = np.array(KMeans(k=cells, seed=SEED, maxIter=8, initSteps=1).fit(some).clusterCenters())
    out = VectorIndex(spark, path.rstrip("/"), metric, dim, centres)
    out._add(ws.save(v.mapInArrow(_placed(centres, metric), "id long, vec array<double>, cell int, gap double"), "placed"), "overwrite")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    if {"text", "n_tokens"} <= set(nodes.columns):
        _texts(nodes).write.parquet(f"{path}/texts")
    spark.createDataFrame([(metric, dim)], "metric string, dim int").coalesce(1).write.json(f"{path}/facts")
    return out


def load(spark: SparkSession, path: str) -> VectorIndex:
    """A saved index; one without its facts was not written to the end."""
    if not exists(spark, f"{path}/facts"):
        raise ValueError(f"no saved index at {path}")
    facts = spark.read.schema("metric string, dim int").json(f"{path}/facts").first()
    centres = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    return VectorIndex(spark, path.rstrip("/"), facts["metric"], facts["dim"], np.array([r["centre"] for r in centres]).reshape(len(centres), facts["dim"]))


def from_documents(docs: DataFrame, embed: Callable[[Column], Column], path: str, config: C.Chunking = C.Chunking(), metric: str = "cosine", id_col: str = "doc_id") -> VectorIndex:
    """An index over the chunks of whole documents, numbered in order of document and place."""
    ws = Scratch(docs.sparkSession, "index")
    c = ws.save(C.exploded(C.chunks(docs.select(F.col(id_col).alias("doc"), "text"), config), "doc"), "chunks")
    return build(ws.save(leaves(c.withColumn("embedding", embed(F.col("text"))), "doc", "pos"), "leaves"), path, metric)


def from_tree(tree: Tree, path: str, metric: str = "cosine", layer: int | None = 0) -> VectorIndex:
    """An index over the nodes of one layer of a tree (of all, if it is None)."""
    nodes = tree.nodes if layer is None else tree.nodes.where(F.col("layer") == layer)
    return build(nodes.select("node_id", "embedding", "text", "n_tokens"), path, metric)
