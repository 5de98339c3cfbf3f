"""Queries over streams of events: windows and sessions in append mode, run over what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from treeloom.sources import frames as L
from treeloom.sources.scratch import shared_folder
from treeloom.streaming import calls as K
from treeloom.streaming import windows as W


def stream_windows(spark, sf):
    """Quarters of an hour by event type that the watermark, an hour behind the last event, has closed."""
    out = W.drain(W.tumbling(W.read(spark, sf, "events")), "stream_windows")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("slot"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sessions(spark, sf):
    """Closed sessions of users with gaps under 30 minutes."""
    out = W.drain(W.sessions(W.read(spark, sf, "events")), "stream_sessions")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def stream_tool_calls(spark, sf):
    """Pieces of calls (here a user's events of a day) put together, as a stream; the arguments as a digest."""
    e = W.read(spark, sf, "events").select(F.col("user_id").alias("call"), F.col("event_id").alias("seq"), F.col("event_type").alias("name"), F.col("props").alias("part"), "ts")
    out = W.drain(W.tool_calls(e), "stream_tool_calls")
    return out.select("call", F.date_format("day", "yyyy-MM-dd").alias("day"), "name", F.length("arguments").cast("long").alias("length"), F.md5("arguments").alias("digest"))


def stream_call_fold(spark, sf):
    """A user's events of a day as the pieces of a call, folded with state; calls that no piece has reached for a day by the watermark."""
    e = W.read(spark, sf, "events").select(F.concat_ws(":", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("call"), F.col("event_id").alias("seq"), F.col("event_type").alias("name"), F.col("props").alias("part"), F.lit(None).cast("long").alias("pieces"), "ts")
    with K.state_store(spark):
        out = W.drain(K.folded(e, 86400), "stream_call_fold")
    return out.select("call", "name", "n_pieces", "outcome", F.length("arguments").cast("long").alias("length"), F.md5("arguments").alias("digest"))


def stream_dashboard(spark, sf):
    """A frame for every five seconds with events, closed ones alone."""
    return W.drain(W.dashboard(W.read(spark, sf, "events")), "stream_dashboard").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def dashboard_frames(spark, sf):
    """The pushes of the dashboard as JSON frames, written by one stream to a frame log and read from it by another."""
    spark.dataSource.register(L.FrameLog)
    at = f"{shared_folder(spark)}/dashboard_frames-{uuid.uuid4().hex}"
    pushes = W.dashboard(W.read(spark, sf, "events")).select(F.to_json(F.struct(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "errors", "status")).alias("frame"))
    pushes.writeStream.format("frame_log").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/log").awaitTermination()
    f = W.drain(spark.readStream.format("frame_log").load(f"{at}/log"), "dashboard_frames")
    return f.select(F.from_json("frame", "start string, n long, errors long, status string").alias("f")).select("f.*")


def _answers(spark, sf):
    return spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'assistant'").select("conv_id", "turn", "text", (F.col("turn") % 4 == 1).alias("tool"))


def frame_stream(spark, sf):
    """The JSON frames of all answers, as counts and lengths for each type and answer."""
    f = W.as_json(W.frames(_answers(spark, sf)))
    kind = F.get_json_object("frame", "$.type").alias("type")
    return f.select("conv_id", "turn", kind, F.length(F.coalesce(F.get_json_object("frame", "$.content"), F.lit(""))).alias("n")).groupBy("conv_id", "turn", "type").agg(F.count("*").alias("frames"), F.sum("n").cast("long").alias("characters"))


def conversations_rebuilt(spark, sf):
    """Answers put together from their frames; those of every seventh turn lack their end."""
    f = W.frames(_answers(spark, sf)).where("NOT (turn % 7 = 3 AND type = 'stream_end')")
    return W.reassembled(f).withColumn("text", F.md5("text"))


QUERIES = {f.__name__: f for f in (stream_windows, stream_sessions, stream_tool_calls, stream_call_fold, stream_dashboard, dashboard_frames, frame_stream, conversations_rebuilt)}

_MARK = "(SELECT max(ts) - INTERVAL '1 hour' FROM events)"
_A = "a AS (SELECT conv_id, turn, text, turn % 4 = 1 AS tool FROM conversations WHERE role = 'assistant')"
ORACLES = {
    "stream_tool_calls": f"SELECT user_id AS call, strftime(ts, '%Y-%m-%d') AS day, max_by(event_type, event_id) AS name, length(string_agg(props, '' ORDER BY event_id))::BIGINT AS length, md5(string_agg(props, '' ORDER BY event_id)) AS digest FROM events WHERE date_trunc('day', ts) + INTERVAL '1 day' <= {_MARK} GROUP BY user_id, strftime(ts, '%Y-%m-%d')",
    "stream_call_fold": f"SELECT user_id || ':' || strftime(ts, '%Y-%m-%d') AS call, max_by(event_type, event_id) AS name, count(*)::BIGINT AS n_pieces, 'timeout' AS outcome, length(string_agg(props, '' ORDER BY event_id))::BIGINT AS length, md5(string_agg(props, '' ORDER BY event_id)) AS digest FROM events GROUP BY user_id, strftime(ts, '%Y-%m-%d') HAVING max(ts) + INTERVAL '1 day' <= {_MARK}",
    "stream_dashboard": f"SELECT *, CASE WHEN errors * 2 > n THEN 'critical' WHEN errors > 0 THEN 'degraded' ELSE 'healthy' END AS status FROM (SELECT strftime(time_bucket(INTERVAL '5 seconds', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*)::BIGINT AS n, (count(*) FILTER (event_type = 'error'))::BIGINT AS errors FROM events WHERE time_bucket(INTERVAL '5 seconds', ts) + INTERVAL '5 seconds' <= {_MARK} GROUP BY time_bucket(INTERVAL '5 seconds', ts))",
    "stream_windows": f"SELECT strftime(time_bucket(INTERVAL '15 minutes', ts), '%Y-%m-%d %H:%M') AS slot, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events WHERE time_bucket(INTERVAL '15 minutes', ts) + INTERVAL '15 minutes' <= {_MARK} GROUP BY time_bucket(INTERVAL '15 minutes', ts), event_type",
    "stream_sessions": f"WITH e AS (SELECT *, coalesce((ts - lag(ts) OVER w >= INTERVAL '30 minutes')::INT, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*)::BIGINT AS n FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL '30 minutes' <= {_MARK}",
    "frame_stream": f"WITH {_A}, f AS (SELECT conv_id, turn, 'stream_start' AS type, 1 AS frames, 0 AS characters FROM a UNION ALL SELECT conv_id, turn, 'stream_end', 1, 0 FROM a UNION ALL SELECT conv_id, turn, 'content_chunk', ceil(length(text) / 40.0), length(text) FROM a WHERE length(text) > 0 UNION ALL SELECT conv_id, turn, t, 1, 0 FROM a, (VALUES ('tool_calls_start'), ('rag_search'), ('rag_complete'), ('final_response_start')) v(t) WHERE tool) SELECT conv_id, turn, type, sum(frames)::BIGINT AS frames, sum(characters)::BIGINT AS characters FROM f GROUP BY ALL",
    "conversations_rebuilt": f"WITH {_A} SELECT conv_id, turn, md5(coalesce(text, '')) AS text, ceil(length(coalesce(text, '')) / 40.0)::BIGINT AS n_pieces, tool::INT::BIGINT AS searches, tool AS tools, CASE WHEN turn % 7 = 3 THEN 'timeout' WHEN length(coalesce(text, '')) = 0 THEN 'empty' ELSE 'complete' END AS outcome FROM a",
}
ORACLES["dashboard_frames"] = ORACLES["stream_dashboard"]
