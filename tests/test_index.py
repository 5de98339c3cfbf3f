import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treeloom.functions import text as T
from treeloom.operators import index as I
from treeloom.operators import retrieval as R
from treeloom.sources.trees import Tree


def _table(spark, n=1500, dim=8, groups=25):
    rng = np.random.default_rng(9)
    centre = rng.normal(size=(groups, dim)) * 6
    x = centre[rng.integers(0, groups, n)] + rng.normal(size=(n, dim)) * 0.3
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(n + i, x[0].tolist()) for i in range(300)]  # a third more in one place
    rows += [(9001, None), (9002, []), (9003, [float("nan")] * dim), (9004, [1.0]), (None, x[1].tolist()), (9005, [0.0] * dim)]
    return spark.createDataFrame(rows, "node_id long, embedding array<double>")


@pytest.mark.parametrize("metric", I.METRICS)
def test_search_is_that_of_a_full_scan(spark, tmp_path, metric):
    nodes = _table(spark)
    index = I.build(nodes, str(tmp_path / "index"), metric)
    queries = nodes.where("node_id % 37 = 0 OR node_id = 9005").select(F.col("node_id").alias("query_id"), F.col("embedding").alias("q"))
    queries = queries.union(spark.createDataFrame([(-1, [0.5] * 8), (-1, [0.1] * 8), (-2, [1.0]), (-3, None)], "query_id long, q array<double>"))
    fine = nodes.where("size(embedding) = 8 AND node_id <> 9003")
    want = {(r.query_id, r.rank): (r.node_id, round(r.d, 7)) for r in R.nearest(queries.where("size(q) = 8"), fine, 7, metric).collect()}
    found = I.load(spark, str(tmp_path / "index")).search(queries, 7, probes=3)
    rows = found.collect()
    assert {(r.query_id, r.rank): (r.node_id, round(r.d, 7)) for r in rows} == want
    total = index.stats().count()
    if metric != "inner":  # groups are apart, so few cells can hold a neighbour
        assert total > 20 and sum(r.cells for r in rows) / len(rows) < total / 2
    assert index.stats().agg(F.sum("n")).first()[0] == 1801
    near = index.search(queries, 7, probes=3, exact=False)
    assert near.agg(F.max("cells")).first()[0] == 3
    both = near.join(found, ["query_id", "node_id"]).count()
    assert both >= 0.9 * len(want) or metric == "inner"


def test_blocks_are_rings(spark, tmp_path):
    index = I.build(_table(spark), str(tmp_path / "index"), "l2", cells=4)
    back = index.vectors().collect()
    assert len(back) == 1801
    for cell, centre in enumerate(index.centres):
        for r in index.cells.where(F.col("cell") == cell).collect():
            gap = np.sqrt(((np.frombuffer(r.data, np.float64).reshape(-1, 8) - centre) ** 2).sum(1))
            assert abs(gap.min() - r.near) < 1e-9 and abs(gap.max() - r.far) < 1e-9 and r.n == len(gap) <= I.BLOCK


def test_add_and_texts(spark, tmp_path):
    letters = lambda t: T.letter_vector(t)
    texts = [(i, f"{'abcdefghijklmnopqrstuvwxyz'[i % 26] * (i % 7 + 1)} and more text {i}") for i in range(60)]
    nodes = spark.createDataFrame(texts, "node_id long, text string").withColumn("n_tokens", F.lit(5)).withColumn("embedding", letters(F.col("text")))
    tree = Tree(nodes.where("node_id < 40").withColumn("layer", F.lit(0)).unionByName(nodes.where("node_id >= 40").withColumn("layer", F.lit(1))), None)
    index = I.from_tree(tree, str(tmp_path / "index"))
    assert index.texts.count() == 40
    index.add(nodes.where("node_id >= 40"))
    queries = nodes.where("node_id % 10 = 0").select(F.col("node_id").alias("query_id"), F.col("embedding").alias("q"))
    want = [tuple(r) for r in R.nearest(queries, nodes, 5).select("query_id", "rank", "node_id").orderBy("query_id", "rank").collect()]
    assert [tuple(r) for r in index.search(queries, 5, probes=2).select("query_id", "rank", "node_id").orderBy("query_id", "rank").collect()] == want
    assert index.texts.count() == 60 and index.check(letters).select("holds").collect() == [(True,)] * 4
    other = index.check(lambda t: F.transform(T.letter_vector(t), lambda x: 1 - x))
    assert not other.where("holds").count()


def test_documents_and_edges(spark, tmp_path):
    docs = spark.createDataFrame([(1, "One sentence here. Another one there."), (2, None), (3, "")], "doc_id long, text string")
    index = I.from_documents(docs, T.letter_vector, str(tmp_path / "a"))
    assert index.texts.count() == index.stats().agg(F.sum("n")).first()[0] >= 1 and index.check(T.letter_vector).where("NOT holds").count() == 0
    empty = I.build(_table(spark).where("false"), str(tmp_path / "b"))
    assert empty.search(spark.createDataFrame([(1, [1.0])], "query_id long, q array<double>")).count() == 0
    with pytest.raises(ValueError):
        I.build(_table(spark), str(tmp_path / "a"))
    with pytest.raises(ValueError):
        I.load(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        I.build(_table(spark), str(tmp_path / "c"), "l1")


def _peak(step, batch):
    """MB that a step holds at most over a batch, and what it gives."""
    tracemalloc.start()
    out = [b for b in step(iter([batch]))]
    top = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return top, out


@pytest.mark.parametrize("metric", I.METRICS)
def test_memory_does_not_grow_with_cells(metric):
    rng = np.random.default_rng(3)
    x, centres = rng.normal(size=(2000, 8)), rng.normal(size=(I.CELLS, 8))
    first = [np.array([i % 9, 9 + i % 5], np.int32) for i in range(2000)]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(2000)), "vec": list(x), "kth": np.full(2000, -50.0 if metric == "inner" else 0.02), "cells": pa.array(first, pa.list_(pa.int32()))})
    far = rng.uniform(0.5, 1, I.CELLS)
    for step in (I._placed(centres, metric), I._nearest_cells(centres, metric, 8), I._other_cells(centres, far / 2, far, metric)):
        top, out = _peak(step, batch)
        assert top < 40 and [i for b in out for i in b["id"].to_pylist()] == list(range(2000))
    low = I._least(I._gaps(x, centres), far / 2, far, x @ centres.T, np.linalg.norm(x, axis=1)[:, None], metric)
    want = [sorted(set(np.flatnonzero(r <= k + I.SLACK).tolist()) - set(c.tolist())) for r, k, c in zip(low, batch["kth"].to_numpy(), first)]
    assert [c for b in out for c in b["cells"].to_pylist()] == want


def test_hits_of_many_queries_leave_as_arrays():
    rng = np.random.default_rng(4)
    q, x = rng.normal(size=(20_000, 2)), rng.normal(size=(50, 2))
    at = range(0, 20_000, 250)  # blocks of queries
    row = {"dim": [2] * 80, "ids": [np.arange(50).tobytes()] * 80, "data": [x.tobytes()] * 80, "near": [0.0] * 80, "far": [9.0] * 80, "n": [50] * 80, "cell": [0] * 80}
    row |= {"q_ids": [np.arange(100 + i, 350 + i).tobytes() for i in at], "q_kth": [np.full(250, np.inf).tobytes()] * 80, "q_data": [q[i : i + 250].tobytes() for i in at]}
    top, out = _peak(I._searched(np.zeros((1, 2)), 10, "inner"), pa.RecordBatch.from_pydict(row))
    d = np.round(-(q @ x.T), 9)
    want = np.argsort(d, axis=1, kind="stable")[:, :10]
    got = {c: np.concatenate([b[c].to_numpy() for b in out]).reshape(-1, 10) for c in ("query_id", "node_id", "d")}
    assert (got["query_id"][:, 0] == np.arange(100, 20_100)).all() and (got["node_id"] == want).all() and (got["d"] == np.take_along_axis(d, want, 1)).all()
    assert top < 22
