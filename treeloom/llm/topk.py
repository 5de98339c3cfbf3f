"""Exact top-k search by distributed histogram selection.

Every query is scored against every row, block by block. Rounds of histograms narrow the
range of each query's kth score: a task reports, for each query, the counts of its highest
bins down to k scores; summed, they show the bin that holds the kth, and the next round
divides that bin, until it is one score wide. Then all scores above it are whole, and those equal to it are
taken by smaller vec_id.

Blocks are rows of packed vectors of one length. Blocks of rows are dealt to as many parts as
there are cores, and every block of queries goes to each part of its length under a join key of
its own: the query set is stated by the caller and grows with the data, so neither side is
broadcast as a whole or collected, and no side meets the other by a cross join.

Cases: vectors that are null, empty, or hold a null or a non-finite component take no part; vectors
meet those of their length alone; fewer than k candidates: all; ties go to the smaller vec_id; rows that share
a vec_id are a candidate each and, for each length, one query (the least vector), and no candidate of their own; scores beyond a long are cut to its range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.llm.common import Workspace

K, SCALE, BLOCK, BINS = 10, 1024, 2048, 1024
LONG = (1 << 63) - 1
#: Counts that a task holds before it gives them out.
HELD = 200_000


def _blocks(scale: float, block: int):
    """Packs vectors into blocks: ids and scaled components, as float64 (whole numbers)."""

    def run(batches):
        held: dict[int, list] = {}

        def out(dim):
            ids, m = (np.concatenate(x) for x in zip(*held.pop(dim)))
            return pa.RecordBatch.from_pydict({"ids": [ids.astype("<i8").tobytes()], "dim": pa.array([dim], pa.int32()), "data": [m.tobytes()], "size": pa.array([float(np.abs(m).max(initial=0))])})

        for batch in batches:
            dims = np.diff(batch["vec"].offsets.to_numpy())
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                m = np.floor(scale * own["vec"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))
                held.setdefault(dim, []).append((own["id"].to_numpy(), m))
                if sum(len(i) for i, _ in held[dim]) >= block:
                    yield out(dim)
        for dim in list(held):
            yield out(dim)

    return run


def _scores(q: np.ndarray, c: np.ndarray, big: float) -> np.ndarray:
    if big * q.shape[1] < 2**53:
        return (q @ c.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in c], object).T
    return np.clip(exact, -LONG - 1, LONG).astype(np.int64)


def _pairs(batches):
    """Each pair of a query block and a block of rows: query ids, row ids, scores; a query's own row left out as None."""
    for batch in batches:
        for i in range(batch.num_rows):
            g = lambda name, i=i: batch[name][i].as_py()
            dim = g("dim")
            qi, ci = np.frombuffer(g("q_ids"), np.int64), np.frombuffer(g("ids"), np.int64)
            q, c = (np.frombuffer(g(x), np.float64).reshape(-1, dim) for x in ("q_data", "data"))
            lows, highs = (np.frombuffer(g(x), np.int64) for x in ("lows", "highs"))
            yield dim, qi, ci, _scores(q, c, g("size") * g("q_size")), lows, highs


def _histograms(k: int, bins: int):
    """Counts of the highest bins of each query in its range [low, high]; bin ``bins`` is above the range."""

    def run(batches):
        total: dict[tuple[int, int], dict[int, int]] = {}
        held = 0

        def out():
            rows = [(*q, b, n) for q, x in total.items() for b, n in x.items()]
            total.clear()
            for i in range(0, len(rows), 50_000):
                part = list(zip(*rows[i : i + 50_000]))
                yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.int32()), pa.array(part[2], pa.int32()), pa.array(part[3], pa.int64())], names=["query_id", "dim", "bin", "n"])

        for dim, qi, ci, s, lows, highs in _pairs(batches):
            for j, query in enumerate(qi.tolist()):
                own = s[j][ci != query]
                low, high = int(lows[j]), int(highs[j])
                own = own[own >= low]
                if len(own) > k:  # the kth of all is no lower than the kth of some
                    own = np.partition(own, len(own) - k)[len(own) - k :]
                width = (high - low) // bins + 1
                # differences of two longs fit an unsigned long, where they wrap as they should
                above = own.astype(np.uint64) - np.uint64(low % (1 << 64))
                at = np.where(own > high, bins, (above // np.uint64(width)).astype(np.int64))
                mine = total.setdefault((query, dim), {})
                before = len(mine)
                for b, n in zip(*(x.tolist() for x in np.unique(at, return_counts=True))):
                    mine[b] = mine.get(b, 0) + n
                held += len(mine) - before
            if held > HELD:
                yield from out()
                held = 0
        yield from out()

    return run


def _winners(k: int):
    def run(batches):
        for _, qi, ci, s, lows, _ in _pairs(batches):
            out = [[], [], []]
            for j, query in enumerate(qi.tolist()):
                at = np.flatnonzero((s[j] >= lows[j]) & (ci != query))
                at = at[np.lexsort((ci[at], -s[j][at]))][:k]
                out[0].append(np.full(len(at), query))
                out[1].append(ci[at])
                out[2].append(s[j][at])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query, k: int = K, scale: float = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, bins: int = BINS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each row for which ``is_query`` holds."""
    spark = vectors.sparkSession
    ws = Workspace(spark, "topk")
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), is_query.alias("q"))
    fine = F.col("id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.coalesce(fine, F.lit(False)))
    packed = "ids binary, dim int, data binary, size double"
    v = ws.save(v, "vectors")
    parts = F.lit(max(1, spark.sparkContext.defaultParallelism)).cast("long")
    c = ws.save(v.select("id", "vec").mapInArrow(_blocks(scale, block), packed).withColumn("part", F.pmod(F.xxhash64("ids"), parts)), "rows")
    queries = v.where("q").groupBy("id", F.size("vec").alias("dim")).agg(F.min("vec").alias("vec"))
    q = queries.select("id", "vec").mapInArrow(_blocks(scale, block // 8), packed)
    q = ws.save(q.select(F.xxhash64("dim", "ids").alias("q_block"), "dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("size").alias("q_size")), "queries")

    # each query's range of scores that holds its kth; (low, high) narrow from round to round
    most = c.groupBy("dim").agg(F.max("size").alias("size")).join(q.groupBy("dim").agg(F.max("q_size").alias("q_size")), "dim")
    bound = F.col("size") * F.col("q_size") * F.col("dim")
    reach = most.select("dim", F.when(bound < float(1 << 62), F.ceil(bound).cast("long")).otherwise(LONG).alias("reach"))  # one row for each length
    owners = ws.save(q.mapInArrow(_owners, "q_block long, dim int, pos int, query_id long"), "owners")
    span = ws.save(owners.select("query_id", "dim").join(reach, "dim").select("query_id", "dim", (-F.col("reach") - 1).alias("low"), F.col("reach").alias("high")), "range")
    wide = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731  (a range may be as wide as all longs)
    step = F.floor((wide("high") - wide("low")) / bins) + 1
    while True:
        ranged = owners.join(span, ["query_id", "dim"]).groupBy("q_block").agg(F.array_sort(F.collect_list(F.struct("pos", "low", "high"))).alias("r"))
        blocks = q.join(ranged, "q_block").mapInArrow(_pack_ranges, "q_block long, dim int, q_ids binary, q_data binary, q_size double, lows binary, highs binary")
        blocks = ws.save(blocks, "blocks").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        pairs = c.join(blocks, ["dim", "part"])
        width = int(span.agg(F.max(wide("high") - wide("low"))).first()[0] or 0) + 1
        if width <= 1:
            break
        hist = pairs.mapInArrow(_histograms(k, bins), "query_id long, dim int, bin int, n long").groupBy("query_id", "dim", "bin").agg(F.sum("n").alias("n"))
        upto = Window.partitionBy("query_id", "dim").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        found = hist.withColumn("upto", F.sum("n").over(upto)).where((F.col("upto") >= k) & (F.col("bin") < bins)).groupBy("query_id", "dim").agg(F.max("bin").alias("bin"))
        new_low = F.when(F.col("bin").isNull(), F.col("low")).otherwise((wide("low") + F.col("bin") * step).cast("long"))
        new_high = F.when(F.col("bin").isNull(), F.col("low")).otherwise(F.least(wide("high"), wide("low") + (F.col("bin") + 1) * step - 1).cast("long"))
        span = ws.save(span.join(found, ["query_id", "dim"], "left").select("query_id", "dim", new_low.alias("low"), new_high.alias("high")), "range")
    hits = pairs.mapInArrow(_winners(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _owners(batches):
    for batch in batches:
        for b, dim, ids in zip(batch["q_block"].to_pylist(), batch["dim"].to_pylist(), batch["q_ids"]):
            x = np.frombuffer(ids.as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), b)), pa.array(np.full(len(x), dim, np.int32)), pa.array(np.arange(len(x), dtype=np.int32)), pa.array(x)], names=["q_block", "dim", "pos", "query_id"])


def _pack_ranges(batches):
    for batch in batches:
        lows, highs = [], []
        for r in batch["r"].to_pylist():
            lows.append(np.array([x["low"] for x in r], np.int64).tobytes())
            highs.append(np.array([x["high"] for x in r], np.int64).tobytes())
        yield pa.RecordBatch.from_arrays([batch["q_block"], batch["dim"], batch["q_ids"], batch["q_data"], batch["q_size"], pa.array(lows, pa.binary()), pa.array(highs, pa.binary())], names=["q_block", "dim", "q_ids", "q_data", "q_size", "lows", "highs"])


def op10_exact_topk(spark, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(e, F.col("vec_id") % 100 == 0)


OP10_SQL = r"""
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS z FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([q.z[i] * c.z[i] FOR i IN range(1, len(q.z) + 1)])::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
