import numpy as np
import pytest
from pyspark.sql import functions as F

from treeloom.functions.numbering import numbered
from treeloom.operators import clusters as C
from treeloom.operators import retrieval as R
from treeloom.operators import retriever as V
from treeloom.operators import tree as T
from treeloom.sources import trees as S
from treeloom.sources.scratch import Scratch

LEAVES = "node_id long, text string, n_tokens long, embedding array<double>"


@pytest.fixture(scope="module")
def tree(spark):
    rows = [(i, f"Leaf {i} of side {i % 2}. More words.", 400, [float(10 * (i % 2)) + i / 100, 1.0, float(i % 3)]) for i in range(40)]
    rows += [(None, "no id", 1, [1.0, 1.0, 1.0]), (99, "no vector", 1, None), (98, "bad", 1, [None, 1.0, 1.0])]
    return T.build(spark.createDataFrame(rows, LEAVES), T.TreeConfig(dim=2))


def test_tree(spark, tree, tmp_path):
    t, took = tree
    assert t.nodes.where("layer = 0").count() == took.chunks == 40 and took.nodes == t.nodes.count() and took.rates()["chunks_per_s"] > 0
    assert {r.child_id for r in t.edges.collect()} >= set(range(40))
    tops = t.nodes.where("layer > 0").collect()
    assert sorted(r.node_id for r in tops) == list(range(40, 40 + len(tops))) == sorted({r.parent_id for r in t.edges.collect()})
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-9 and r.text.startswith("Leaf ") and r.n_tokens <= 100 for r in tops)
    # clusters of too many tokens are clustered again, and those of the two sides are apart
    assert len(tops) >= 2
    path = str(tmp_path / "tree")
    assert S.save(t, path, metadata={"metrics": took.rates()}) and not S.save(t, path) and S.save(t, path, force=True)
    back = S.load(spark, path)
    assert back.nodes.count() == took.nodes and back.stats().first().total_nodes == took.nodes
    assert S.metadata(spark, path).first().tree_stats.leaf_nodes == 40
    with pytest.raises(ValueError):
        S.load(spark, str(tmp_path / "none"))
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert S.whole_texts(spark, str(tmp_path / "a.txt")).first().text == "one\ntwo"


def test_few_nodes_make_no_layer(spark):
    t, _ = T.build(spark.createDataFrame([(1, None, None, [1.0, 0.0])], LEAVES))
    assert t.nodes.count() == 1 and t.edges.count() == 0 and t.stats().first().num_layers == 0


def test_retrieve(spark, tree):
    t, _ = tree
    q = spark.createDataFrame([(1000, [10.0, 1.0, 0.0])], "query_id long, q array<double>")
    hits = V.retrieve(q, t, V.Retrieval(top_k=5, max_tokens=900)).orderBy("rank").collect()
    assert 1 <= len(hits) <= 5 and [h.rank for h in hits] == list(range(1, len(hits) + 1))
    down = V.retrieve(q, t, V.Retrieval(top_k=2, collapse=False))
    assert down.where("layer > 0").count() >= 1 and down.where("layer = 0").count() == 2
    c = V.contexts(down, t).first().context
    assert c.count("\n\n") == down.count() and "Leaf" in c
    for bad in (V.Retrieval(max_tokens=0), V.Retrieval(top_k=0), V.Retrieval(collapse=1), V.Retrieval(start_layer=9), V.Retrieval(start_layer=0, num_layers=2), V.Retrieval(num_layers=0)):
        with pytest.raises(ValueError):
            bad.check(1)


def test_vectors_that_can_not_be_compared(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [2.0, 0.0]), (8, [0.0, 1.0]), (7, [2.0, 0.0])]
    n = spark.createDataFrame(rows, "node_id long, embedding array<double>")
    q = n.select(F.col("node_id").alias("query_id"), F.col("embedding").alias("q"))
    got = {}
    for r in R.nearest(q, n, 9).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.node_id, r.d))
    assert got[1] == [(7, 0.0), (7, 0.0), (2, 1.0), (8, 1.0)] and {d for _, d in got[2]} == {1.0} and set(got) == {1, 2, 7, 8}
    assert [r.node_id for r in R.nearest(q.where("query_id = 1"), n, 2, "inner").orderBy("rank").collect()] == [7, 7]
    assert R.nearest(q.where("false"), n).count() == R.nearest(q, n.where("false")).count() == 0
    with pytest.raises(ValueError):
        R.nearest(q, n, 1, "no")
    hits = R.nearest(q.where("query_id = 1"), n, 4)
    assert R.select(hits, "top_k", 2).count() == 2 and R.select(hits, "threshold", threshold=0.5).count() == 2


@pytest.mark.parametrize("budget, sure, ranks", [(5, 0.8, []), (25, 0.8, [1, 2, 3]), (25, 0.4, [1, 2]), (99, 0.4, [1, 2, 3])])
def test_ends_early(spark, budget, sure, ranks):
    hits = spark.createDataFrame([(0, i, i, 0.5, 10, 1.0) for i in (1, 2, 3)], "query_id long, rank int, node_id long, d double, n_tokens long, far double")
    assert [r.rank for r in R.ends_early(hits, budget, sure).orderBy("rank").collect()] == ranks


def test_numbers(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("v"), F.lit("x").alias("row")).repartition(7)
    got = numbered(df, "no", "v", start=5).collect()
    assert len(got) == 1000 and all(r.no == r.v + 5 and r.row == "x" for r in got)
    assert numbered(df.where("false"), "no", "v").count() == 0


def test_plug_ins_from_documents_to_tree(spark):
    import pyarrow as pa

    from treeloom.functions.embedding import embedder

    @F.arrow_udf("string")
    def shout(texts: pa.Array) -> pa.Array:
        return pa.array([f"{len(t)}!" for t in texts.to_pylist()])

    def parity(level, n, config, ws):
        return level.select((F.col("node_id") % 2).cast("string").alias("path"), "node_id")

    seen = []
    docs = spark.createDataFrame([(i, f"Document {i} tells of a subject. " * (3 + i % 3)) for i in range(30)] + [(30, None), (31, "")], "doc_id long, text string")
    plugins = T.Plugins(shout, embedder(lambda texts: [[float(len(t)), 1.0] for t in texts]), F.length, parity, seen.append)
    t, took = T.from_documents(docs, T.TreeConfig(layers=1, dim=2, max_tokens=500), T.Chunking(max_tokens=60, fallback=True), plugins)
    low, high = t.nodes.where("layer = 0").orderBy("node_id").collect(), t.nodes.where("layer = 1").orderBy("node_id").collect()
    assert len(low) == took.chunks >= 30 and [r.node_id for r in low] == list(range(len(low)))
    assert all(r.n_tokens == len(r.text) - r.text.count(". ") and list(r.embedding) == [float(len(r.text)), 1.0] for r in low)
    for side, r in enumerate(high):
        own, held = [x.text for x in low if x.node_id % 2 == side], []
        for x in own:
            if held and sum(map(len, held)) + len(x) > 500:
                break
            held.append(x)
        assert r.text == f"{len((chr(10) * 2).join(held))}!" and r.n_tokens == len(r.text) and list(r.embedding) == [float(len(r.text)), 1.0]
    assert [(p.layer, p.nodes, p.tokens, p.links) for p in seen] == [(1, 2, sum(r.n_tokens for r in high), len(low))] and len(high) == 2


def test_answerer_plug_in(spark):
    asked = spark.createDataFrame([("q", "c"), ("r", None)], "question string, context string")
    got = V.answered(asked, lambda q, c: F.concat(q, F.coalesce(c, F.lit("-")))).collect()
    assert [r.answer for r in got] == ["qc", "r-"]


def test_parts_of_a_group_keep_its_merges(spark, monkeypatch):
    rng = np.random.default_rng(8)
    spots = [6 * rng.normal(size=4) + 60 * (k // 6) for k in range(12)]
    x = np.concatenate([s + rng.normal(size=(150, 4)) for s in spots])
    level = spark.createDataFrame([(i, "a", 50, r.tolist()) for i, r in enumerate(x)], "node_id long, text string, n_tokens long, embedding array<double>")
    made, fresh = [], C.W.tree_of
    monkeypatch.setattr(C.W, "tree_of", lambda *a: made.append(1) or fresh(*a))
    layer = lambda *a: (level.select("node_id", (F.col("node_id") >= 900).cast("int").alias("cluster")), 0.9, None)
    monkeypatch.setattr(T, "_layer_clusters", layer)
    monkeypatch.setattr(C.grouped, "__defaults__", (10, 0.1, 0.2, 100, None))
    config = T.TreeConfig(depth=3)
    got = {(r.path, r.node_id) for r in T.clustered(level, len(x), config, Scratch(spark, "kept")).collect()}
    assert len(made) == 1 and len({p for p, _ in got}) > 4
    monkeypatch.setattr(T, "_within", lambda *a: None)
    assert got == {(r.path, r.node_id) for r in T.clustered(level, len(x), config, Scratch(spark, "anew")).collect()} and len(made) == 3
