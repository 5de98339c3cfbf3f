"""Metrics of requests: ranks, latencies, grades, health, alerts, recommendations, grids of time.

Every rule is a column that gives a code; sums and counts are combined before they are shuffled, and values at
given ranks are found by histogram, so that no group has to fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.sources.scratch import Scratch

BUCKETS = 1024


def at_ranks(rows: DataFrame, by: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """(by, n, names): the values at given places (from 0) of each group's sorted values, nulls left out.

    ``ranks`` are columns over ``n``, the group's number of values. A group's values are counted, dealt to
    buckets of its range, and only the buckets that hold a place are sorted, each by itself.
    """
    ws = Scratch(rows.sparkSession, "ranks")
    v = ws.save(rows.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("by"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c")), "values")
    span = v.groupBy("by").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("c").alias("n"))
    at = F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * BUCKETS), F.lit(BUCKETS - 1))
    dealt = v.join(span.withColumnRenamed("by", "b"), F.expr("by <=> b")).select("by", "v", "c", F.when(F.col("high") > F.col("low"), at).otherwise(0).alias("bucket"))
    w = Window.partitionBy("by").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = dealt.groupBy("by", "bucket").agg(F.sum("c").alias("k")).withColumn("base", F.coalesce(F.sum("k").over(w), F.lit(0)))  # at most BUCKETS rows a group
    wanted = span.select(F.col("by").alias("b"), "n", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), place.cast("long").alias("place")) for name, place in ranks.items()))).alias("r")).select("b", "n", "r.name", "r.place")
    spots = ws.save(held.join(wanted, F.expr("by <=> b AND place >= base AND place < base + k")).select("b", "n", "name", "place", F.col("bucket").alias("q"), "base"), "spots")
    inside = dealt.join(spots.select("b", "q", "base").distinct(), F.expr("by <=> b AND bucket = q"))
    upto = F.sum("c").over(Window.partitionBy("by", "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("upto", F.col("base") + upto).select("by", "v", "c", "upto")
    found = inside.join(spots.select("b", "n", "name", "place"), F.expr("by <=> b AND place < upto AND place >= upto - c"))
    return found.groupBy(F.col("by").alias(by), "n").agg(*(F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks))


def nearest_rank(p: float) -> Column:
    """Place of a percentile by nearest rank."""
    return F.least(F.floor(F.lit(p) * F.col("n")), F.col("n") - 1)


def latencies(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, mean, median, low, high, p95, p99) of each group's values; nulls left out."""
    half = (F.col("n") - 1) / 2
    r = at_ranks(rows, by, value, {"p95": nearest_rank(0.95), "p99": nearest_rank(0.99), "m0": F.floor(half), "m1": F.ceil(half)})
    s = rows.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("b")).agg(F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return r.join(s, F.col(by).eqNullSafe(F.col("b"))).select(by, "n", "mean", ((F.col("m0") + F.col("m1")) / 2).alias("median"), "low", "high", "p95", "p99")


def load_summary(requests: DataFrame, by: str) -> DataFrame:
    """(by, total, ok, failed, timeouts, tools, success, duration_s, rps, errors, unique_errors) of requests (ts, outcome, tool, error)."""
    span = (F.max("ts").cast("timestamp").cast("double") - F.min("ts").cast("timestamp").cast("double")).alias("duration_s")
    s = requests.groupBy(by).agg(
        F.count("*").alias("total"), F.count_if(F.col("outcome") == "ok").alias("ok"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.count_if(F.col("outcome") == "timeout").alias("timeouts"),
        F.count_if((F.col("outcome") == "ok") & F.col("tool")).alias("tools"), span, F.count("error").alias("errors"), F.count_distinct("error").alias("unique_errors"),
    )
    return s.withColumn("success", 100 * F.col("ok") / F.greatest("total", F.lit(1))).withColumn("rps", F.col("total") / F.greatest("duration_s", F.lit(0.1)))


def _kept(*rules: tuple[Column, str]) -> Column:
    """The codes of the rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(rule, text) for rule, text in rules)))


def load_grade(s: DataFrame) -> DataFrame:
    """The rows of (avg_ms, p95_ms, success, rps, ok, tools, timeouts, memory_mb, cpu) with grade, bottlenecks, recommendations, warnings and optimizations."""
    ms, p95, ok = F.col("avg_ms"), F.col("p95_ms"), F.col("success")
    slow = [ms > 15000, (ms > 10000) & (ms <= 15000), (ms > 7000) & (ms <= 10000)]
    timeouts, high = F.col("timeouts") > F.col("ok") * 0.1, p95 > ms * 4
    grade = F.when((ok < 80) | (ms > 15000), "F").when(ms > 10000, "D").when(ms > 7000, "C").when(ms > 5000, "B").otherwise("A")
    return s.withColumns({
        "grade": grade,
        "bottlenecks": _kept((slow[0], "latency_very_high"), (slow[1], "latency_high"), (ok < 80, "errors_high"), (F.col("rps") < 0.5, "throughput_low"), (timeouts, "timeouts_high"), (high, "latency_spread")),
        "recommendations": _kept(
            (slow[0], "look_at_tree_and_embedder"), (slow[1], "stop_early"), (slow[2], "more_in_parallel"), (ok < 80, "look_at_tree_and_store"),
            (F.col("rps") < 0.5, "more_hardware"), ((F.col("rps") >= 0.5) & (F.col("rps") < 2), "work_asynchronously"), (timeouts, "longer_timeout"), (high, "bound_requests"),
        ),
        "warnings": _kept(((ok >= 80) & (ok < 90), "errors_some"), (F.col("memory_mb") > 8000, "memory_high"), (F.col("cpu") > 90, "cpu_high")),
        "optimizations": _kept(((F.col("tools") > 0) & (F.col("tools") / F.greatest("ok", F.lit(1)) > 0.8), "cache_retrievals"), (F.col("memory_mb") > 8000, "save_memory"), (F.col("cpu") > 90, "more_workers")),
    })


def tuned(graded: DataFrame, batch: int = 100, concurrent: int = 10, ttl: int = 3600, top_k: int = 10, workers: int = 4) -> DataFrame:
    """The rows with batch_size, concurrent, cache_ttl, top_k and workers that suit their bottlenecks; later rules overrule earlier ones."""
    has = lambda c, x: F.array_contains(c, x)
    very, slow = has("bottlenecks", "latency_very_high"), has("bottlenecks", "latency_high")
    memory, low = has("warnings", "memory_high"), has("bottlenecks", "throughput_low")
    return graded.withColumns({
        "batch_size": F.when(low, min(batch * 2, 250)).when(memory, max(batch // 2, 25)).when(very, min(batch * 2, 300)).when(slow, int(batch * 1.5)).otherwise(batch),
        "concurrent": F.when(low, min(concurrent * 2, 16)).when(memory, max(concurrent // 2, 4)).when(very, min(concurrent + 6, 20)).when(slow, concurrent + 3).otherwise(concurrent),
        "cache_ttl": F.when(memory, 1800).when(very, 7200).when(slow, 3600).otherwise(ttl),
        "top_k": F.when(memory, 3).when(very, 5).otherwise(top_k),
        "workers": F.when(low, min(workers * 2, 8)).otherwise(workers),
    })


def health(s: DataFrame) -> DataFrame:
    """The rows of (memory, cpu, store_error, tree_ready) with issues, score and status."""
    memory, cpu = F.col("memory"), F.col("cpu")
    less = F.when(memory > 90, 30).when(memory > 80, 15).otherwise(0) + F.when(cpu > 90, 25).when(cpu > 80, 10).otherwise(0) + F.when(F.col("store_error"), 40).otherwise(0) + F.when(F.col("tree_ready"), 0).otherwise(35)
    issues = _kept((memory > 90, "memory_critical"), ((memory > 80) & (memory <= 90), "memory_high"), (cpu > 90, "cpu_critical"), ((cpu > 80) & (cpu <= 90), "cpu_high"), (F.col("store_error"), "store_unreachable"), (~F.coalesce("tree_ready", F.lit(False)), "tree_missing"))
    raw = 100 - less
    return s.withColumns({"issues": issues, "score": F.greatest(raw, F.lit(0)), "status": F.when(raw >= 90, "excellent").when(raw >= 75, "good").when(raw >= 50, "degraded").otherwise("critical")})


def memory_alerts(system: Column, process: Column, available_gb: Column) -> Column:
    return _kept(
        (system > 90, "system_critical"), ((system > 80) & (system <= 90), "system_high"), (process > 50, "process_high"),
        (available_gb < 1, "free_critical"), ((available_gb >= 1) & (available_gb < 2), "free_low"),
    )


def analytics(s: DataFrame) -> DataFrame:
    """The rows of (response_s, error_rate, throughput, peak_memory) with grade, score and insights."""
    r, e = F.col("response_s"), F.col("error_rate")
    grade = F.when((r > 5) | (e > 3), "F").when((r > 4) | (e > 2), "D").when((r > 3) | (e > 1.5), "C").when((r > 2.5) | (e > 1), "B").otherwise("A")
    score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 - (r - 1) * 20 - e * 10))
    return s.withColumns({"grade": grade, "score": score, "insights": _kept((r > 3, "latency_high"), (F.col("peak_memory") > 85, "memory_peak"), (F.col("throughput") < 10, "throughput_low"))})


def recommendations(hit_rate: Column, query_s: Column, nodes: Column) -> Column:
    found = _kept(
        (hit_rate < 0.5, "keep_cached_longer"), (hit_rate > 0.9, "cache_good"), (query_s > 5, "stop_early"), (query_s < 1, "queries_fast"),
        (nodes > 10000, "tree_large"),
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("nothing_to_do")))


def retrieval_metrics(retrievals: DataFrame) -> DataFrame:
    """One row (total, cache_hits, hit_rate, avg_s, total_s, avg_nodes, qps, layer_usage) of retrievals (seconds, n_nodes, cache_hit, layers)."""
    n = F.greatest(F.count("*"), F.lit(1))
    whole = retrievals.agg(
        F.count("*").alias("total"), F.count_if("cache_hit").alias("cache_hits"), (F.count_if("cache_hit") / n).alias("hit_rate"), (F.coalesce(F.sum("seconds"), F.lit(0.0)) / n).alias("avg_s"),
        F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("total_s"), (F.coalesce(F.sum("n_nodes"), F.lit(0)) / n).alias("avg_nodes"), (F.count("*") / F.greatest(F.coalesce(F.sum("seconds"), F.lit(0.0)), F.lit(0.1))).alias("qps"),
    )
    layers = retrievals.select(F.explode("layers").alias("layer")).groupBy("layer").agg(F.count("*").alias("n"))
    usage = layers.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("layer", "n")))).alias("layer_usage"))  # a tree has few layers
    return whole.crossJoin(usage)


# Points and minutes of a point of each range of time; an unknown range counts as 24h.
GRIDS = {"1h": (60, 1), "6h": (72, 5), "24h": (96, 15), "7d": (168, 60), "30d": (120, 360)}


def grid(events: DataFrame, now: str, span: str = "24h") -> DataFrame:
    """(slot, n, mean, errors) of the points of a range that ends at ``now``, empty points included; events (ts, value, failed)."""
    points, minutes = GRIDS.get(span, GRIDS["24h"])
    end = F.lit(now).cast("timestamp_ntz")
    at = F.floor(F.expr(f"timestampdiff(SECOND, ts, timestamp_ntz'{now}')") / (60 * minutes))
    inside = events.where((F.col("ts") <= end)).withColumn("at", at).where(F.col("at") < points)
    s = inside.groupBy("at").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.count_if("failed").alias("errors"))
    slots = events.sparkSession.range(points).select(F.col("id").alias("slot_at"), F.expr(f"timestampadd(MINUTE, -cast(id as int) * {minutes}, timestamp_ntz'{now}')").alias("slot"))
    return slots.join(s, F.col("slot_at") == F.col("at"), "left").select("slot", F.coalesce("n", F.lit(0)).alias("n"), "mean", F.coalesce("errors", F.lit(0)).alias("errors"))
