"""Windowed aggregates over streams, with watermarks; in append mode, so that closed windows leave the state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.sources.scratch import exists, shared_folder


def read(spark: SparkSession, sf_dir: str, table: str, files_per_batch: int | None = None) -> DataFrame:
    """A table's files as a stream; time stamps without a zone get the session's."""
    at = f"{sf_dir}/{table}.parquet"
    s = spark.readStream.schema(spark.read.parquet(at).schema)
    if files_per_batch:
        s = s.option("maxFilesPerTrigger", files_per_batch)
    s = s.parquet(f"{sf_dir}/{table[:-1]}[{table[-1]}].parquet")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total); rows later than the watermark are dropped, and a window goes once none can come."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, n) of each session."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return w.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def once(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Events whose key has not come within the watermark's time."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def tool_calls(deltas: DataFrame, late: str = "1 hour") -> DataFrame:
    """(call, day, name, arguments) of calls that arrive in pieces (call, seq, name, part, ts).

    The last name that isn't null wins, parts are joined by seq. A call ends with its day, and
    a call's parts are one string, so they fit a task.
    """
    parts = deltas.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "call").agg(
        F.max_by("name", F.when(F.col("name").isNotNull(), F.col("seq"))).alias("name"), F.collect_list(F.struct("seq", "part")).alias("parts")
    )
    return parts.select("call", F.col("w.start").alias("day"), "name", F.array_join(F.transform(F.array_sort("parts"), lambda p: p["part"]), "").alias("arguments"))


def dashboard(events: DataFrame, every: str = "5 seconds", late: str = "1 hour") -> DataFrame:
    """(start, n, errors, status) of each push; a status other than healthy is an alert."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    state = F.when(F.col("errors") * 2 > F.col("n"), "critical").when(F.col("errors") > 0, "degraded").otherwise("healthy")
    return w.select(F.col("w.start").alias("start"), "n", "errors", state.alias("status"))


# Types of the frames of an answer, in the order that they come.
FRAMES = ("stream_start", "content_chunk", "tool_calls_start", "rag_search", "rag_complete", "final_response_start", "stream_end")


def frames(messages: DataFrame, size: int = 40) -> DataFrame:
    """(conv_id, turn, seq, type, content) of answers (conv_id, turn, text, tool): start, pieces of ``size`` characters, a search if ``tool``, end.

    A null text has no pieces.
    """
    n = F.ceil(F.length("text") / F.lit(size)).cast("int")
    pieces = F.when(F.length("text") > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr("text", i * size + 1, F.lit(size))))
    mark = lambda kind: F.struct(F.lit(kind).alias("type"), F.lit(None).cast("string").alias("content"))
    found = F.when(F.col("tool"), F.array(*(mark(k) for k in FRAMES[2:6]))).otherwise(F.array().cast("array<struct<type:string,content:string>>"))
    chunks = F.transform(F.coalesce(pieces, F.array().cast("array<string>")), lambda p: F.struct(F.lit(FRAMES[1]).alias("type"), p.alias("content")))
    all_ = F.concat(F.array(mark(FRAMES[0])), found, chunks, F.array(mark(FRAMES[6])))
    return messages.select("conv_id", "turn", F.posexplode(all_).alias("seq", "f")).select("conv_id", "turn", "seq", F.col("f.type").alias("type"), F.col("f.content").alias("content"))


def as_json(framed: DataFrame) -> DataFrame:
    """(conv_id, turn, seq, frame): frames as JSON texts for a sink, without fields that are null."""
    return framed.select("conv_id", "turn", "seq", F.to_json(F.struct("type", "content")).alias("frame"))


def reassembled(framed: DataFrame) -> DataFrame:
    """(conv_id, turn, text, n_pieces, searches, tools, outcome) of frames (conv_id, turn, seq, type, content), batch or stream.

    An answer without its end is a timeout; one that ended without content is empty. An answer's frames fit a task.
    """
    count = lambda kind: F.count_if(F.col("type") == kind)
    held = F.array_sort(F.collect_list(F.when(F.col("type") == "content_chunk", F.struct("seq", "content"))))
    g = framed.groupBy("conv_id", "turn").agg(F.array_join(F.transform(held, lambda h: h["content"]), "").alias("text"), count("content_chunk").alias("n_pieces"), count("rag_search").alias("searches"), (count("tool_calls_start") > 0).alias("tools"), (count("stream_end") > 0).alias("ended"))
    return g.select("conv_id", "turn", "text", "n_pieces", "searches", "tools", F.when(~F.col("ended"), "timeout").when(F.col("n_pieces") == 0, "empty").otherwise("complete").alias("outcome"))


def drain(stream: DataFrame, name: str, mode: str = "append", at: str | None = None) -> DataFrame:
    """Runs a stream over all there is now and gives what it put out, in earlier runs at the folder ``at`` too.

    In append mode that is the windows that the watermark has closed; ``complete`` has open ones
    too, but keeps every window in its state. Results and state go to the folder all executors
    share; each micro-batch writes a table of its own, so one that is run again leaves no row twice.
    """
    spark = stream.sparkSession
    base = at or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={0 if mode == 'complete' else n}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not exists(spark, f"{base}/out"):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select(stream.columns)
