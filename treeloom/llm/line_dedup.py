"""Line dedup: lines that several documents hold stay only in the first of them.

Two Bloom filters (hashes seen once, hashes seen again) find suspected repeats; only
suspects are shuffled, as SHA-256 keys, to confirm them exactly and choose the first
document.

Cases: a null or empty text is one empty line; keys under ``min_chars`` code points never
repeat; rows with a null doc_id keep all lines; rows that share a doc_id are one document,
so a line that only they hold stays in all of them; other columns are left alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import PACKED, WS, Workspace, join_by_key, pack_hashes, repeat_filter

MIN_CHARS = 10
_STRIP = WS.encode()


def line_keys(text: str | None, min_chars: int = MIN_CHARS):
    """(line, key) of each line; the key is None where it is too short to count."""
    for line in (text or "").encode().split(b"\n"):
        key = line.strip(_STRIP).lower()  # bytes.lower changes A-Z alone
        n = len(key)
        if n < min_chars or n < 4 * min_chars and len(key.decode()) < min_chars:
            key = None
        yield line, key


def _pack(min_chars: int):
    def run(batches):
        for batch in batches:
            seen = []
            for doc, text in zip(batch["id"], batch["text"]):
                if doc.is_valid:
                    seen.extend({xxhash.xxh3_64_intdigest(k) for _, k in line_keys(text.as_py(), min_chars) if k is not None})
            rows = list(pack_hashes(np.array(seen, np.uint64)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["seg", "n", "once", "again"])

    return run


def _suspects(shared, min_chars: int):
    def run(batches):
        repeats = shared.value
        for batch in batches:
            ids, keys, hashes = [], [], []
            for doc, text in zip(batch["id"].to_pylist(), batch["text"]):
                if doc is None:
                    continue
                for key in {k for _, k in line_keys(text.as_py(), min_chars) if k is not None}:
                    ids.append(doc)
                    keys.append(key)
                    hashes.append(xxhash.xxh3_64_intdigest(key))
            hit = repeats(np.array(hashes, np.uint64))
            at = np.flatnonzero(hit)
            if len(at):
                yield pa.RecordBatch.from_pydict({"key": pa.array([hashlib.sha256(keys[i]).digest() for i in at], pa.binary()), "id": pa.array([ids[i] for i in at], pa.int64())})

    return run


def _cut(min_chars: int):
    """Adds to each row the text without the lines whose keys stand in ``drops``."""

    def run(batches):
        for batch in batches:
            kept, lines_n, dropped_n = [], [], []
            for text, drops in zip(batch["text"], batch["drops"]):
                text = text.as_py()
                gone = set(drops.as_py() or ())
                if not gone:
                    kept.append(text)
                    lines_n.append((text or "").count("\n") + 1)
                    dropped_n.append(0)
                    continue
                lines = list(line_keys(text, min_chars))
                stay = [line for line, key in lines if key is None or hashlib.sha256(key).digest() not in gone]
                kept.append(b"\n".join(stay).decode())
                lines_n.append(len(lines))
                dropped_n.append(len(lines) - len(stay))
            yield pa.RecordBatch.from_arrays([batch["row"], batch["id"], pa.array(kept, pa.string()), pa.array(lines_n, pa.int64()), pa.array(dropped_n, pa.int64())], names=["row", "id", "kept", "n_lines", "n_dropped"])

    return run


def line_drops(docs: DataFrame, ws: Workspace, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, drops): for each document that loses lines, the SHA-256 keys of those lines."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    packed = ws.save(d.mapInArrow(_pack(min_chars), PACKED), "hashes")
    shared = spark.sparkContext.broadcast(repeat_filter(ws, packed))
    ws.drop(packed)
    found = ws.save(d.mapInArrow(_suspects(shared, min_chars), "key binary, id long").distinct(), "suspects")
    firsts = ws.save(found.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1"), "firsts")
    hits = join_by_key(found, firsts, "key", "n").where("id <> first")
    return hits.groupBy("id").agg(F.collect_list("key").alias("drops"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with their kept text in ``text_col``, and n_lines and n_dropped.

    Columns of ``docs`` that are called n_lines or n_dropped are replaced.
    """
    ws = Workspace(docs.sparkSession, "line_dedup")
    drops = line_drops(docs, ws, id_col, text_col, min_chars)
    rest = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"))
    joined = rows.join(drops, "id", "left").select("row", "id", "text", "drops")
    schema = joined.select("row", "id").schema.add("kept", "string").add("n_lines", "long").add("n_dropped", "long")
    out = joined.mapInArrow(_cut(min_chars), schema)
    cols = [F.col("kept").alias(text_col) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*cols, "n_lines", "n_dropped")


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (
  SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.first_doc AS gone
  FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
