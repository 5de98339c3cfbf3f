"""Queries over events and conversations: latencies, grades, health, grids, sessions, caches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from treeloom.operators import metrics as M
from treeloom.operators import query_cache as Q
from treeloom.sources import sessions as S

NOW = "2024-01-31 00:00:00"


def _events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


def _requests(spark, sf):
    """Events as requests: errors fail, logouts of users divisible by three time out, purchases use a tool; a value is tenths of a second."""
    kind = F.col("event_type")
    out = F.when(kind == "error", "failed").when((kind == "logout") & (F.col("user_id") % 3 == 0), "timeout").otherwise("ok")
    return _events(spark, sf).select("user_id", "ts", "event_type", F.col("value").alias("tenths"), out.alias("outcome"), (kind == "purchase").alias("tool"), F.when(out != "ok", F.get_json_object("props", "$.k")).alias("error"))


def latency_percentiles(spark, sf):
    """Latencies of each event type; percentiles by nearest rank."""
    s = M.latencies(_events(spark, sf), "event_type", "value")
    return s.select("event_type", "n", *(F.round(c, 4).alias(c) for c in ("mean", "median", "low", "high", "p95", "p99")))


def load_summary(spark, sf):
    s = M.load_summary(_requests(spark, sf), "user_id")
    return s.select("user_id", "total", "ok", "failed", "timeouts", "tools", "errors", "unique_errors", *(F.round(c, 4).alias(c) for c in ("success", "duration_s", "rps")))


def _graded(spark, sf):
    r = _requests(spark, sf)
    t = M.latencies(r, "user_id", "tenths").select(F.col("user_id").alias("u"), (F.col("mean") * 100).alias("avg_ms"), (F.col("p95") * 100).alias("p95_ms"), F.col("high"))
    s = M.load_summary(r, "user_id").join(t, F.expr("user_id <=> u")).withColumns({"memory_mb": F.col("high") * 20, "cpu": F.col("high") / 5, "rps": F.col("rps") * 100000})
    return M.load_grade(s)


def load_grade(spark, sf):
    """Each user's load graded; memory and CPU follow from the largest value."""
    g = _graded(spark, sf)
    return g.select("user_id", "grade", *(F.array_join(c, ";").alias(c) for c in ("bottlenecks", "warnings", "optimizations")), F.size("recommendations").alias("n_recommendations"))


def tuned_config(spark, sf):
    return M.tuned(_graded(spark, sf)).select("user_id", "batch_size", "concurrent", "cache_ttl", "top_k", "workers")


def _days(spark, sf):
    return _events(spark, sf).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.max("value").alias("high"), F.avg("value").alias("mean"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("n"))


def health_score(spark, sf):
    """Days as states of a system: the largest value is memory, three times the mean CPU, many errors a store error."""
    d = _days(spark, sf).select("day", F.least(F.col("high") / 5, F.lit(100.0)).alias("memory"), (3 * F.col("mean")).alias("cpu"), (F.col("errors") * 5 > F.col("n")).alias("store_error"), (F.dayofmonth(F.to_date("day")) % 5 != 0).alias("tree_ready"))
    return M.health(d).select("day", F.col("score").cast("long").alias("score"), "status", F.array_join("issues", ";").alias("issues"))


def memory_alerts(spark, sf):
    d = _days(spark, sf)
    a = M.memory_alerts(F.col("high") / 5, F.col("mean") * 2, F.col("mean") / 10)
    return d.select("day", F.array_join(a, ";").alias("alerts"))


def resource_peaks(spark, sf):
    """Peak and mean of each day's values, and the estimate of a tree's memory for so many nodes."""
    return _days(spark, sf).select("day", F.round("high", 6).alias("peak"), F.round("mean", 6).alias("mean"), F.round(F.col("n") * 0.1, 2).alias("estimated_tree_mb"))


def analytics_grade(spark, sf):
    d = _days(spark, sf).select("day", (F.col("mean") / 20).alias("response_s"), (100 * F.col("errors") / F.col("n") / 10).alias("error_rate"), (F.col("n") / 24).alias("throughput"), (F.col("high") / 5).alias("peak_memory"))
    return M.analytics(d).select("day", "grade", F.round("score", 6).alias("score"), F.array_join("insights", ";").alias("insights"))


def live_metrics(spark, sf):
    """Counters of each day's end: rates of errors and requests, hits of a store (views) against misses (clicks)."""
    e = _events(spark, sf).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "view").alias("hits"), F.count_if(F.col("event_type") == "click").alias("misses"), F.count_distinct("user_id").alias("sessions"))
    return e.select("day", "requests", "errors", "sessions", F.round(100 * F.col("errors") / F.greatest("requests", F.lit(1)), 2).alias("error_rate"), F.round(F.col("requests") / 86400, 4).alias("rps"), F.round(100 * F.col("hits") / F.greatest(F.col("hits") + F.col("misses"), F.lit(1)), 2).alias("hit_ratio"))


def recommendations(spark, sf):
    d = live_metrics(spark, sf).join(_days(spark, sf).select("day", "mean", "n"), "day")
    return d.select("day", F.array_join(M.recommendations(F.col("hit_ratio") / 100, F.col("mean") / 20, F.col("n") * 30), ";").alias("recommendations"))


def retrieval_metrics(spark, sf):
    """Metrics of retrievals, here the events: a value is seconds and nodes, views are hits, the layers follow from the id."""
    e = _events(spark, sf).select((F.col("value") / 100).alias("seconds"), F.floor("value").alias("n_nodes"), (F.col("event_type") == "view").alias("cache_hit"), F.transform(F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int")), lambda i: i).alias("layers"))
    m = M.retrieval_metrics(e)
    return m.select("total", "cache_hits", *(F.round(c, 4).alias(c) for c in ("hit_rate", "avg_s", "total_s", "avg_nodes", "qps")), F.array_join(F.transform(F.map_entries("layer_usage"), lambda x: F.concat_ws(":", x["key"].cast("string"), x["value"].cast("string"))), ";").alias("layer_usage"))


def historical_grid(spark, sf):
    """All five ranges of time up to the table's end, empty points included."""
    e = _events(spark, sf).select("ts", "value", (F.col("event_type") == "error").alias("failed"))
    out = None
    for span in M.GRIDS:
        g = M.grid(e, NOW, span).select(F.lit(span).alias("span"), F.date_format("slot", "yyyy-MM-dd HH:mm").alias("slot"), "n", F.round("mean", 6).alias("mean"), "errors")
        out = g if out is None else out.unionByName(g)
    return out


def user_sessions(spark, sf):
    """Runs of a user's events with gaps of at most 30 minutes."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _events(spark, sf).withColumn("new", F.coalesce((F.col("ts") - F.lag("ts").over(w) > F.expr("interval 30 minutes")).cast("int"), F.lit(1)))
    e = e.withColumn("session", F.sum("new").over(w))
    return e.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def session_status(spark, sf):
    idle = F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.unix_timestamp(F.max("ts").cast("timestamp"))
    s = _events(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"), idle.alias("idle_s"))
    return s.withColumn("status", S.status(F.col("idle_s")))


def _messages(spark, sf):
    """Conversations as stored messages, a minute between turns."""
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    ts = F.timestamp_seconds(F.lit(1706572800) + F.col("conv_id") * 97 + F.col("turn") * 60)
    return c.select(F.concat(F.lit("session-"), F.col("conv_id").cast("string")).alias("session_id"), "turn", "role", F.col("text").alias("content"), ts.alias("ts"))


def session_list(spark, sf):
    c = _messages(spark, sf)
    return c.groupBy("session_id").agg(F.count("*").alias("n_messages"), F.min_by("content", "turn").alias("first_text"), F.max_by("content", "turn").alias("last_text"))


def session_page(spark, sf):
    """The second page of ten of the inactive sessions with a 1 in their id."""
    p = S.listed(_messages(spark, sf), "2024-01-31 12:00:00", "inactive", "SSION-1", 10, 10)
    return p.select("session_id", "n_messages", "status", F.date_format("last_activity", "yyyy-MM-dd HH:mm:ss").alias("last_activity"), "total", "has_more")


def session_history(spark, sf):
    """Turns of every tenth session as stored JSON, read again in order."""
    m = _messages(spark, sf).where("cast(substring(session_id, 9) AS long) % 10 = 0").select("session_id", "turn", F.to_json(F.struct("role", "content")).alias("stored"))
    back = m.withColumn("m", F.from_json("stored", "role string, content string"))
    return back.select("session_id", "turn", F.col("m.role").alias("role"), F.md5("m.content").alias("content"))


def keys_removed(spark, sf):
    """How many keys of each pattern a clearing of caches removes; histories stay."""
    kinds = F.array(F.lit("cache:"), F.lit("temp:"), F.lit("session_temp:"), F.lit("query_cache:"), F.lit("chat_history:"))
    keys = _events(spark, sf).select(F.concat(F.get(kinds, (F.col("event_id") % 5).cast("int")), F.col("event_id").cast("string")).alias("key"))
    return S.removed(keys, ["cache:*", "temp:*", "session_temp:*", "query_cache:*"])[1]


def _entries(spark, sf):
    """User turns as cached queries, each an hour apart."""
    c = spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'user'")
    params = F.create_map(F.lit("top_k"), F.lit("10"), F.lit("collapse"), (F.col("turn") % 2 == 0).cast("string"))
    ts = F.timestamp_seconds(F.lit(1706572800) + (F.col("conv_id") % 90) * 60 + F.col("turn"))
    return c.select("conv_id", "turn", F.col("text").alias("query"), params.alias("params"), ts.alias("ts"))


def query_keys(spark, sf):
    return _entries(spark, sf).select("conv_id", "turn", Q.query_hash(F.col("query"), F.col("params")).alias("query_hash"))


def query_cache(spark, sf):
    """User turns looked up, an hour and a half later, in the cache that the turns themselves make, the last of each query."""
    e = _entries(spark, sf)
    cache = e.select(Q.query_hash(F.col("query"), F.col("params")).alias("query_hash"), "ts", F.concat_ws("-", "conv_id", "turn").alias("result")).groupBy("query_hash").agg(F.max("ts").alias("ts"), F.max_by("result", F.struct("ts", "result")).alias("result"))
    asked = e.select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), "query", "params", F.lit("2024-01-30 01:30:00").cast("timestamp").alias("now"))
    return Q.lookup(asked, cache)


def cache_insert(spark, sf):
    """The 100 users seen last, as a bounded cache keeps them."""
    e = _events(spark, sf).select(F.col("user_id").cast("string").alias("query_hash"), F.col("event_id").alias("accessed"))
    old, new = e.where("accessed % 2 = 0").groupBy("query_hash").agg(F.max("accessed").alias("accessed")), e.where("accessed % 2 = 1")
    return Q.inserted(old, new, 100)


def cache_sweep(spark, sf):
    """Entries that a sweep of those older than three days leaves, by type."""
    return Q.swept(_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), NOW, 3 * 86400).groupBy("event_type").agg(F.count("*").alias("n"))


def cache_split(spark, sf):
    """Which texts a cache of the labelled documents lacks."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    return d.join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id"), "doc_id", "left_anti")


def recurse_decision(spark, sf):
    """Clusters (here languages) of more than 3 documents whose words pass 3500 are divided further."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("lang", F.regexp_count("text", F.lit(r"\S+")).alias("w"))
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.sum("w").alias("words")).withColumn("recurse", (F.col("n") > 3) & (F.col("words") > 3500)).select("lang", "n", "recurse")


QUERIES = {
    f.__name__: f
    for f in (
        latency_percentiles, load_summary, load_grade, tuned_config, health_score, memory_alerts, resource_peaks, analytics_grade, live_metrics, recommendations, retrieval_metrics, historical_grid, user_sessions,
        session_status, session_list, session_page, session_history, keys_removed, query_keys, query_cache, cache_insert, cache_sweep, cache_split, recurse_decision,
    )
}

_RANK = "list_sort(list(value))[least(floor({0}::DOUBLE * count(value)), count(value) - 1)::BIGINT + 1]"
_REQ = "r AS (SELECT *, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'logout' AND user_id % 3 = 0 THEN 'timeout' ELSE 'ok' END AS outcome, event_type = 'purchase' AS tool FROM events)"
_SUM = f"{_REQ}, s AS (SELECT user_id, count(*)::BIGINT AS total, (count(*) FILTER (outcome = 'ok'))::BIGINT AS ok, (count(*) FILTER (outcome = 'failed'))::BIGINT AS failed, (count(*) FILTER (outcome = 'timeout'))::BIGINT AS timeouts, (count(*) FILTER (outcome = 'ok' AND tool))::BIGINT AS tools, count(CASE WHEN outcome <> 'ok' THEN json_extract_string(props, '$.k') END)::BIGINT AS errors, count(DISTINCT CASE WHEN outcome <> 'ok' THEN json_extract_string(props, '$.k') END)::BIGINT AS unique_errors, 100.0::DOUBLE * count(*) FILTER (outcome = 'ok') / count(*) AS success, epoch(max(ts)) - epoch(min(ts)) AS duration_s, count(*) / greatest(epoch(max(ts)) - epoch(min(ts)), 0.1)::DOUBLE AS rps, avg(value) * 100 AS avg_ms, {_RANK.replace('{0}', '0.95')} * 100 AS p95_ms, max(value) AS high FROM r GROUP BY user_id)"
_GR = "g AS (SELECT * REPLACE (rps * 100000 AS rps), high * 20 AS memory_mb, high / 5 AS cpu, CASE WHEN success < 80 OR avg_ms > 15000 THEN 'F' WHEN avg_ms > 10000 THEN 'D' WHEN avg_ms > 7000 THEN 'C' WHEN avg_ms > 5000 THEN 'B' ELSE 'A' END AS grade FROM s)"
_LIST = "array_to_string([x FOR x IN [{0}] IF x IS NOT NULL], ';')"
_RULE = lambda *r: _LIST.replace("{0}", ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in r))
_BOTTLE = _RULE(("avg_ms > 15000", "latency_very_high"), ("avg_ms > 10000 AND avg_ms <= 15000", "latency_high"), ("success < 80", "errors_high"), ("rps < 0.5", "throughput_low"), ("timeouts > ok * 0.1", "timeouts_high"), ("p95_ms > avg_ms * 4", "latency_spread"))
_COUNT = " + ".join(f"({c})::INT" for c in ("avg_ms > 15000", "avg_ms > 10000 AND avg_ms <= 15000", "avg_ms > 7000 AND avg_ms <= 10000", "success < 80", "rps < 0.5", "rps >= 0.5 AND rps < 2", "timeouts > ok * 0.1", "p95_ms > avg_ms * 4"))
_DAY = "d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, max(value) AS high, avg(value) AS mean, count(*) FILTER (event_type = 'error') AS errors, count(*) AS n, count(DISTINCT user_id) AS sessions, count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type = 'click') AS misses FROM events GROUP BY 1)"
_HIT = "round(100.0::DOUBLE * hits / greatest(hits + misses, 1), 2)"
_MSG = "m AS (SELECT 'session-' || conv_id AS session_id, turn, role, text, make_timestamp((1706572800 + conv_id * 97 + turn * 60) * 1000000) AS ts FROM conversations)"
_KEY = "substr(sha256(text || ':[(collapse, ' || (turn % 2 = 0) || '), (top_k, 10)]'), 1, 16)"
ORACLES = {
    "latency_percentiles": f"SELECT event_type, count(value)::BIGINT AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(min(value), 4) AS low, round(max(value), 4) AS high, round({_RANK.replace('{0}', '0.95')}, 4) AS p95, round({_RANK.replace('{0}', '0.99')}, 4) AS p99 FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "load_summary": f"WITH {_SUM} SELECT user_id, total, ok, failed, timeouts, tools, errors, unique_errors, round(success, 4) AS success, round(duration_s, 4) AS duration_s, round(rps, 4) AS rps FROM s",
    "load_grade": f"WITH {_SUM}, {_GR} SELECT user_id, grade, {_BOTTLE} AS bottlenecks, {_RULE(('success >= 80 AND success < 90', 'errors_some'), ('memory_mb > 8000', 'memory_high'), ('cpu > 90', 'cpu_high'))} AS warnings, {_RULE(('tools > 0 AND tools / greatest(ok, 1)::DOUBLE > 0.8', 'cache_retrievals'), ('memory_mb > 8000', 'save_memory'), ('cpu > 90', 'more_workers'))} AS optimizations, ({_COUNT})::INT AS n_recommendations FROM g",
    "tuned_config": f"WITH {_SUM}, {_GR} SELECT user_id, CASE WHEN rps < 0.5 THEN 200 WHEN memory_mb > 8000 THEN 50 WHEN avg_ms > 15000 THEN 200 WHEN avg_ms > 10000 THEN 150 ELSE 100 END AS batch_size, CASE WHEN rps < 0.5 THEN 16 WHEN memory_mb > 8000 THEN 5 WHEN avg_ms > 15000 THEN 16 WHEN avg_ms > 10000 THEN 13 ELSE 10 END AS concurrent, CASE WHEN memory_mb > 8000 THEN 1800 WHEN avg_ms > 15000 THEN 7200 ELSE 3600 END AS cache_ttl, CASE WHEN memory_mb > 8000 THEN 3 WHEN avg_ms > 15000 THEN 5 ELSE 10 END AS top_k, CASE WHEN rps < 0.5 THEN 8 ELSE 4 END AS workers FROM g",
    "health_score": f"WITH {_DAY}, h AS (SELECT day, least(high / 5, 100) AS memory, 3 * mean AS cpu, errors * 5 > n AS store_error, substr(day, 9, 2)::INT % 5 <> 0 AS tree_ready FROM d), s AS (SELECT *, 100 - CASE WHEN memory > 90 THEN 30 WHEN memory > 80 THEN 15 ELSE 0 END - CASE WHEN cpu > 90 THEN 25 WHEN cpu > 80 THEN 10 ELSE 0 END - CASE WHEN store_error THEN 40 ELSE 0 END - CASE WHEN tree_ready THEN 0 ELSE 35 END AS raw FROM h) SELECT day, greatest(raw, 0)::BIGINT AS score, CASE WHEN raw >= 90 THEN 'excellent' WHEN raw >= 75 THEN 'good' WHEN raw >= 50 THEN 'degraded' ELSE 'critical' END AS status, {_RULE(('memory > 90', 'memory_critical'), ('memory > 80 AND memory <= 90', 'memory_high'), ('cpu > 90', 'cpu_critical'), ('cpu > 80 AND cpu <= 90', 'cpu_high'), ('store_error', 'store_unreachable'), ('NOT tree_ready', 'tree_missing'))} AS issues FROM s",
    "memory_alerts": f"WITH {_DAY}, a AS (SELECT day, high / 5 AS s, mean * 2 AS p, mean / 10 AS g FROM d) SELECT day, {_RULE(('s > 90', 'system_critical'), ('s > 80 AND s <= 90', 'system_high'), ('p > 50', 'process_high'), ('g < 1', 'free_critical'), ('g >= 1 AND g < 2', 'free_low'))} AS alerts FROM a",
    "resource_peaks": f"WITH {_DAY} SELECT day, round(high, 6) AS peak, round(mean, 6) AS mean, round(n * 0.1::DOUBLE, 2) AS estimated_tree_mb FROM d",
    "analytics_grade": f"WITH {_DAY}, a AS (SELECT day, mean / 20 AS r, 100.0::DOUBLE * errors / n / 10 AS e, n / 24.0::DOUBLE AS t, high / 5 AS p FROM d) SELECT day, CASE WHEN r > 5 OR e > 3 THEN 'F' WHEN r > 4 OR e > 2 THEN 'D' WHEN r > 3 OR e > 1.5 THEN 'C' WHEN r > 2.5 OR e > 1 THEN 'B' ELSE 'A' END AS grade, round(least(100, greatest(0, 100 - (r - 1) * 20 - e * 10)), 6) AS score, {_RULE(('r > 3', 'latency_high'), ('p > 85', 'memory_peak'), ('t < 10', 'throughput_low'))} AS insights FROM a",
    "live_metrics": f"WITH {_DAY} SELECT day, n::BIGINT AS requests, errors::BIGINT AS errors, sessions::BIGINT AS sessions, round(100.0::DOUBLE * errors / greatest(n, 1), 2) AS error_rate, round(n / 86400.0::DOUBLE, 4) AS rps, {_HIT} AS hit_ratio FROM d",
    "recommendations": f"WITH {_DAY}, a AS (SELECT day, {_HIT} / 100 AS h, mean / 20 AS q, n * 30 AS n FROM d), b AS (SELECT day, {_RULE(('h < 0.5', 'keep_cached_longer'), ('h > 0.9', 'cache_good'), ('q > 5', 'stop_early'), ('q < 1', 'queries_fast'), ('n > 10000', 'tree_large'))} AS x FROM a) SELECT day, CASE WHEN x = '' THEN 'nothing_to_do' ELSE x END AS recommendations FROM b",
    "retrieval_metrics": "SELECT count(*)::BIGINT AS total, (count(*) FILTER (event_type = 'view'))::BIGINT AS cache_hits, round((count(*) FILTER (event_type = 'view'))::DOUBLE / count(*), 4) AS hit_rate, round(sum(value / 100) / count(*), 4) AS avg_s, round(sum(value / 100), 4) AS total_s, round(sum(floor(value)) / count(*), 4) AS avg_nodes, round(count(*) / greatest(sum(value / 100), 0.1), 4) AS qps, '0:' || count(*) || ';1:' || (count(*) FILTER (event_id % 3 >= 1)) || ';2:' || (count(*) FILTER (event_id % 3 = 2)) AS layer_usage FROM events",
    "historical_grid": " UNION ALL ".join(f"SELECT '{span}' AS span, strftime(TIMESTAMP '{NOW}' - i * INTERVAL '{minutes} minutes', '%Y-%m-%d %H:%M') AS slot, count(e.ts)::BIGINT AS n, round(avg(e.value), 6) AS mean, (count(*) FILTER (e.event_type = 'error'))::BIGINT AS errors FROM range({points}) g(i) LEFT JOIN events e ON e.ts <= TIMESTAMP '{NOW}' - i * INTERVAL '{minutes} minutes' AND e.ts > TIMESTAMP '{NOW}' - (i + 1) * INTERVAL '{minutes} minutes' GROUP BY i" for span, (points, minutes) in {"1h": (60, 1), "6h": (72, 5), "24h": (96, 15), "7d": (168, 60), "30d": (120, 360)}.items()),
    "user_sessions": "WITH e AS (SELECT *, coalesce((ts - lag(ts) OVER w > INTERVAL '30 minutes')::INT, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, (sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS session FROM e) SELECT user_id, session, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, session",
    "session_status": f"WITH s AS (SELECT user_id, count(*)::BIGINT AS n, floor(epoch(TIMESTAMP '{NOW}'))::BIGINT - floor(epoch(max(ts)))::BIGINT AS idle_s FROM events GROUP BY user_id) SELECT *, CASE WHEN idle_s < 300 THEN 'active' WHEN idle_s < 1800 THEN 'idle' ELSE 'inactive' END AS status FROM s",
    "session_list": f"WITH {_MSG} SELECT session_id, count(*)::BIGINT AS n_messages, min_by(text, turn) AS first_text, max_by(text, turn) AS last_text FROM m GROUP BY session_id",
    "session_page": f"WITH {_MSG}, s AS (SELECT session_id, count(*)::BIGINT AS n_messages, max(ts) AS t FROM m GROUP BY session_id), f AS (SELECT session_id, n_messages, 'inactive' AS status, strftime(t, '%Y-%m-%d %H:%M:%S') AS last_activity, count(*) OVER ()::BIGINT AS total, 20 < count(*) OVER () AS has_more, t FROM s WHERE epoch(TIMESTAMP '2024-01-31 12:00:00') - epoch(t) >= 1800 AND session_id LIKE '%ssion-1%') SELECT * EXCLUDE (t) FROM f ORDER BY t DESC, session_id LIMIT 10 OFFSET 10",
    "session_history": f"WITH {_MSG} SELECT session_id, turn, role, md5(text) AS content FROM m WHERE substr(session_id, 9)::BIGINT % 10 = 0",
    "keys_removed": "SELECT ['cache:*', 'temp:*', 'session_temp:*', 'query_cache:*'][event_id % 5 + 1] AS pattern, count(*)::BIGINT AS n FROM events WHERE event_id % 5 < 4 GROUP BY 1",
    "query_keys": f"SELECT conv_id, turn, {_KEY} AS query_hash FROM conversations WHERE role = 'user'",
    "query_cache": f"WITH e AS (SELECT conv_id || '-' || turn AS id, {_KEY} AS k, 1706572800 + conv_id % 90 * 60 + turn AS ts FROM conversations WHERE role = 'user'), c AS (SELECT k, max(ts) AS ts, arg_max(id, {{'t': ts, 'i': id}}) AS result FROM e GROUP BY k) SELECT e.id AS query_id, epoch(TIMESTAMP '2024-01-30 01:30:00') - c.ts < 3600 AS hit, CASE WHEN epoch(TIMESTAMP '2024-01-30 01:30:00') - c.ts < 3600 THEN c.result END AS result FROM e JOIN c ON c.k = e.k",
    "cache_insert": "WITH e AS (SELECT user_id::VARCHAR AS query_hash, max(CASE WHEN event_id % 2 = 1 THEN event_id END) AS a, max(CASE WHEN event_id % 2 = 0 THEN event_id END) AS b FROM events GROUP BY user_id) SELECT query_hash, coalesce(a, b) AS accessed FROM e ORDER BY accessed DESC, query_hash LIMIT 100",
    "cache_sweep": f"SELECT event_type, count(*)::BIGINT AS n FROM events WHERE epoch(TIMESTAMP '{NOW}') - epoch(ts) <= 259200 GROUP BY event_type",
    "cache_split": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "recurse_decision": r"SELECT lang, count(*)::BIGINT AS n, count(*) > 3 AND sum(len(regexp_extract_all(text, '\S+'))) > 3500 AS recurse FROM documents GROUP BY lang",
}
