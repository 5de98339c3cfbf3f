import numpy as np
from pyspark.sql import functions as F

from treeloom.operators import retrieval as R


def _tables(spark, n=60, parents=5, queries=12):
    rng = np.random.default_rng(8)
    x, top, q = rng.normal(size=(n, 4)), rng.normal(size=(parents, 4)), rng.normal(size=(queries, 4))
    edges = [(-1 - i % parents, i) for i in range(n)] + [(-1 - (i + 1) % parents, i) for i in range(0, n, 3)]
    frames = [spark.createDataFrame([(i * s - o, r.tolist()) for i, r in enumerate(v)], f"{name} long, {vec} array<double>") for v, s, o, name, vec in ((q, 1, -1000, "query_id", "q"), (top, -1, 1, "node_id", "embedding"), (x, 1, 0, "node_id", "embedding"))]
    return (x, top, q, edges), (*frames, spark.createDataFrame(edges, "parent_id long, child_id long"))


def test_beam_by_blocks_of_children(spark):
    (x, top, q, edges), (queries, tops, nodes, links) = _tables(spark)
    out = R.beam(queries, tops, [nodes], links.unionByName(links.limit(7)), 3)
    assert "zip_with" not in out._jdf.queryExecution().toString()  # no distance row by row
    got = {(r.query_id, r.layer, r.rank): (r.node_id, r.d) for r in out.collect()}
    far = lambda a, b: round(1 - a @ b / np.sqrt((a @ a) * (b @ b)), 9)
    for i, v in enumerate(q):
        near = sorted((far(v, t), -1 - j) for j, t in enumerate(top))[:3]
        below = sorted((far(v, x[c]), c) for c in {c for p, c in edges if p in {n for _, n in near}})[:3]
        for layer, want in ((1, near), (0, below)):
            for rank, (d, node) in enumerate(want, 1):
                found = got.pop((1000 + i, layer, rank))
                assert found[0] == node and abs(found[1] - d) < 1e-8
    assert not got


def test_blocks_of_many_kinds_are_given_up(spark):
    rows = spark.range(4000).select(F.col("id"), (F.col("id") % 500).alias("kind"), F.array(F.col("id").cast("double")).alias("vec")).repartition(1).sortWithinPartitions("kind")
    out = rows.mapInArrow(R._blocks(16), "dim int, kind long, name long, ids binary, data binary").select("kind", F.expr("octet_length(ids) DIV 8 AS n")).collect()
    assert sum(r.n for r in out) == 4000 and len(out) <= 1000


def test_arrow_batches_are_bounded(spark):
    for k in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{k}")
    _, (queries, _, nodes, _) = _tables(spark)
    R.knn(queries, nodes, 2)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20
