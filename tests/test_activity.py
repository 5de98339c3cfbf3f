import os

import pytest
from pyspark.sql import functions as F

from treeloom.operators import metrics as M
from treeloom.operators import query_cache as Q
from treeloom.operators import retriever as V
from treeloom.sources import sessions as S
from treeloom.streaming import windows as W


@pytest.mark.parametrize("n", [1, 19, 20, 100])
def test_percentiles(spark, n):
    rows = [("a", float((7 * i) % n)) for i in range(n)] + [("b", 5.0)] * 50 + [(None, 1.0), ("c", None)]
    got = {r.k: r for r in M.latencies(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    v = sorted(x for k, x in rows if k == "a")
    assert got["a"].p95 == v[min(int(0.95 * n), n - 1)] and got["a"].p99 == v[min(int(0.99 * n), n - 1)]
    assert got["a"].median == (v[(n - 1) // 2] + v[n // 2]) / 2 and got["b"].p95 == got["b"].median == 5.0 and got["b"].n == 50
    assert got[None].p99 == 1.0 and "c" not in got


def test_grades(spark):
    cases = [(16000, 95), (12000, 95), (8000, 85), (6000, 95), (4000, 95), (1000, 70)]
    s = spark.createDataFrame([(i, float(ms), 10.0 * ms, float(ok), 1.0, 10, 9, 5, 9000.0, 95.0) for i, (ms, ok) in enumerate(cases)], "i int, avg_ms double, p95_ms double, success double, rps double, ok int, tools int, timeouts int, memory_mb double, cpu double")
    got = {r.i: r for r in M.tuned(M.load_grade(s)).collect()}
    assert [got[i].grade for i in range(6)] == ["F", "D", "C", "B", "A", "F"]
    assert got[2].warnings == ["errors_some", "memory_high", "cpu_high"] and got[0].top_k == 3 and got[0].batch_size == 50
    assert got[0].optimizations[0] == "cache_retrievals" and "latency_spread" in got[4].bottlenecks


QUERY = "query_hash string, query string, params map<string,string>, embedding array<double>, ts timestamp, accessed timestamp, result string"


def test_query_cache(spark):
    now = "2024-01-01 02:00:00"
    at = lambda s: F.timestamp_seconds(F.unix_timestamp(F.lit(now)) - s)
    ages = spark.createDataFrame([("a", 3599), ("b", 3600), ("c", 3601)], "query string, age int")
    p = F.create_map(F.lit("k"), F.lit("1"))
    cache = ages.select(Q.query_hash(F.col("query"), p).alias("query_hash"), "query", p.alias("params"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"), at(F.col("age")).alias("ts"), at(F.col("age")).alias("accessed"), F.col("query").alias("result"))
    asked = ages.select("query").union(spark.createDataFrame([("d",)], "query string")).select(F.col("query").alias("query_id"), "query", p.alias("params"), F.lit(now).cast("timestamp").alias("now"))
    assert {r.query_id: r.result for r in Q.lookup(asked, cache).collect()} == {"a": "a", "b": None, "c": None, "d": None}
    assert [r.query for r in Q.touched(cache, asked).collect()] == ["a"]
    assert sorted(r.query for r in Q.swept(cache, now).collect()) == ["a", "b"]
    assert Q.inserted(cache, cache.where("query = 'a'").withColumn("result", F.lit("new")), 2).where("query = 'a'").first().result == "new"
    assert Q.inserted(cache, cache, 2).count() == 2
    entries = cache.where("query = 'a'").select(F.lit(1).cast("long").alias("entry_id"), "embedding", "params", "ts", F.lit(now).cast("timestamp").alias("now"))
    near = lambda x, v: Q.similar(spark.createDataFrame([(9, [x, 0.0])], "query_id long, q array<double>").withColumn("params", F.create_map(F.lit("k"), F.lit(v))), entries).count()
    assert (near(1.01, "1"), near(1.06, "1"), near(1.01, "2")) == (1, 0, 0)


def test_sessions(spark, tmp_path):
    path = str(tmp_path / "chat")
    rows = [(f"session-{i % 3}", i, "user", f"m{i}") for i in range(9)]
    m = spark.createDataFrame(rows, "session_id string, turn long, role string, content string").withColumn("ts", F.timestamp_seconds(1704067200 + F.col("turn") * 600))
    S.append(m, path)
    S.append(m.where("turn = 0").withColumn("turn", F.lit(9).cast("long")), path)
    assert [r.turn for r in S.history(S.load(spark, path), "session-0").collect()] == [0, 3, 6, 9]
    assert S.delete(spark, path, "abc")["status"] == "error" and S.delete(spark, path, "session-9")["status"] == "warning"
    assert S.delete(spark, path, "session-0") == {"status": "success", "deleted_messages": 4}
    left = S.load(spark, path)
    assert left.count() == 6 and S.history(left, "session-0").count() == 0
    page = S.listed(left, "2024-01-01 01:15:00", limit=1).collect()
    assert [(r.session_id, r.status, r.total, r.has_more) for r in page] == [("session-2", "active", 2, True)]
    assert S.listed(left, "2024-01-01 01:15:00", with_status="inactive").count() == 0 and S.listed(left, "2024-01-01 01:15:00", search="SION-1").count() == 1
    keys = spark.createDataFrame([("cache:1",), ("a_b",), ("axb",)], "key string")
    assert S.matching(keys, "a_b*").count() == 1 and S.matching(keys, "a?b").count() == 2


def test_several_queries(spark):
    r = spark.createDataFrame([(1, 0, "q0", "same  text"), (1, 1, "q1", "other"), (1, 2, "q2", " same text\n"), (2, 0, "q3", "x" * 150)], "batch int, pos int, query string, context string")
    got = {(c.batch, c.content_no): c for c in V.several_queries(r).collect()}
    assert got[1, 0].primary_query == "q0" and got[1, 0].additional_queries == ["q2"] and got[1, 1].additional_queries == [] and got[2, 0].preview == "x" * 100 + "..."
    assert {s.batch: s.ratio for s in V.dedupe_stats(V.several_queries(r)).collect()} == {1: "1/3", 2: "0/1"}
    assert "=== Section 2 ===\nSource: Primary query: q1\nother\n\n" in V.combined(V.several_queries(r)).where("batch = 1").first().document
    a = V.answered(spark.createDataFrame([("Where is the cat?", "A dog barks. The cat is here."), ("x", None)], "question string, context string")).collect()
    assert [x.answer for x in a] == ["The cat is here.", None]


def placed(spark, tmp_path, tables, name):
    """One file for each table in a folder, in the order of their names and times."""
    at = tmp_path / name
    at.mkdir()
    for n, t in enumerate(tables):
        t.coalesce(1).write.parquet(str(tmp_path / f"{name}-{n}"))
        part = next((tmp_path / f"{name}-{n}").glob("part-*"))
        os.utime(part, (1700000000 + n, 1700000000 + n))
        part.rename(at / f"{n}-{part.name}")


def test_late_rows(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double, user_id long, event_id long"
    day = lambda rows: spark.createDataFrame([(t, k, v, 1, i) for i, (t, k, v) in enumerate(rows)], "t string, event_type string, value double, user_id long, event_id long").select(F.col("t").cast("timestamp").alias("ts"), "event_type", "value", "user_id", "event_id")
    at = tmp_path / "events.parquet"
    # four files, one a batch: the last has a row later than the watermark of the batch before and one within it
    for n, rows in enumerate(([("2024-01-01 00:05:00", "a", 1.0)], [("2024-01-01 03:00:00", "a", 2.0)], [("2024-01-01 03:01:00", "a", 1.0)], [("2024-01-01 00:06:00", "a", 9.0), ("2024-01-01 02:10:00", "a", 4.0), ("2024-01-01 06:00:00", "a", 1.0)])):
        day(rows).coalesce(1).write.parquet(str(tmp_path / f"b{n}"))
        at.mkdir(exist_ok=True)
        part = next((tmp_path / f"b{n}").glob("part-*"))
        part.rename(at / f"{n}-{part.name}")
    s = W.read(spark, str(tmp_path), "events", 1)
    assert s.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    got = {r.start.strftime("%H:%M"): (r.n, r.total) for r in W.drain(W.tumbling(s), "late").collect()}
    assert got == {"00:00": (1, 1.0), "03:00": (2, 3.0), "02:00": (1, 4.0)}
    again = W.drain(W.once(W.read(spark, str(tmp_path), "events", 1), "event_type", "100 days"), "once")
    assert again.count() == 1


def test_frames(spark):
    a = spark.createDataFrame([(1, 1, "x" * 95, True), (1, 2, "", False), (2, 1, None, False)], "conv_id int, turn int, text string, tool boolean")
    f = W.frames(a)
    assert [r.type for r in f.where("conv_id = 1 AND turn = 1").orderBy("seq").collect()] == [W.FRAMES[0], *W.FRAMES[2:6], *[W.FRAMES[1]] * 3, W.FRAMES[6]]
    got = {(r.conv_id, r.turn): (r.text, r.n_pieces, r.searches, r.tools, r.outcome) for r in W.reassembled(f.where("NOT (conv_id = 2 AND type = 'stream_end')")).collect()}
    assert got == {(1, 1): ("x" * 95, 3, 1, True, "complete"), (1, 2): ("", 0, 0, False, "empty"), (2, 1): ("", 0, 0, False, "timeout")}
    assert W.as_json(f).where("seq = 0").first().frame == '{"type":"stream_start"}'
