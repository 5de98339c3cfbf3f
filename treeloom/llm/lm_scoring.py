"""Language-model scores of documents by stupid backoff, from counts over the whole corpus.

The model counts n-grams of all documents; a document is scored without its own counts
(leave one out), so that a text isn't rated by itself. Words are lower-cased (A-Z) runs of
``[^\\x20\\x09-\\x0D]``. For each word the longest n-gram that other documents have gives
count / context count, each step back multiplies by ``alpha``; a word that no other document has
counts as one in all words of the others plus one.

Documents are coded in blocks: a block names each of its distinct n-grams once, with its
count. The count tables are partitioned by n-gram hash: blocks send their distinct n-grams
to the partition of the hash, which adds up and joins the totals back to the blocks; a
block then sums the logarithms by document. A very frequent n-gram is one entry for
each block, so no partition gets it once for each document.

Cases: null, empty or blank texts have no tokens and a null score; a row with a null
doc_id is scored like others; rows that repeat are documents of their own; an empty table
stays empty; long texts are a block of their own.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import Workspace, mix

ORDER, ALPHA, BLOCK_WORDS = 2, 0.4, 1_200_000
_P = np.uint64(0x9E3779B97F4A7C15)
_KEY = np.uint64((1 << 48) - 1)
_BLOCKS = "block long, n long, ids array<long>, lengths binary, words binary, codes binary"


def _press(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 3)


def _unpress(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), dtype)


def _keys(hashes: np.ndarray, buckets: int) -> bytes:
    """Six bytes of each hash, which with the bucket (its remainder) stand for it: 54 bits at least, more the more buckets."""
    return ((hashes // np.uint64(buckets)) & _KEY).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unkeys(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _code(block_words: int):
    """Blocks of documents: lengths in words, hashes of distinct words, a code for each word."""

    def run(batches):
        ids, lengths, codes, known = [], [], [], {}

        def out():
            words = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))
            row = (uuid.uuid4().int >> 65, len(codes), list(ids), np.array(lengths, np.int32).tobytes(), words.tobytes(), _press(np.array(codes, np.int32)))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary())
            for x in (ids, lengths, codes, known):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["block", "n", "ids", "lengths", "words", "codes"])

        for batch in batches:
            for i, t in zip(batch["id"].to_pylist(), batch["text"]):
                parts = (t.as_py() or "").encode().lower().split()
                ids.append(i)
                lengths.append(len(parts))
                code = known.setdefault
                codes += [code(w, len(known)) for w in parts]
                if len(codes) >= block_words or len(ids) >= 20_000:
                    yield out()
        if ids:
            yield out()

    return run


def grams(lengths: np.ndarray, words: np.ndarray, codes: np.ndarray, order: int):
    """For n = 1 to order: (n-gram of each place, -1 where none begins; hashes; counts)."""
    ends = np.repeat(np.cumsum(lengths), lengths)
    place = np.arange(len(codes))
    at, hashes = codes.astype(np.int64), mix(words)
    yield at, hashes, np.bincount(at, minlength=len(words))
    for n in range(2, order + 1):
        fits = np.flatnonzero(place + n <= ends)
        pairs = at[fits] * len(words) + codes[fits + n - 1]
        values, inverse, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        hashes = mix((hashes[values // max(1, len(words))] + np.uint64(n)) * _P ^ words[values % max(1, len(words))])
        at = np.full(len(codes), -1)
        at[fits] = inverse
        yield at, hashes, counts


def _unpacked(row):
    return np.frombuffer(row["lengths"], np.int32).astype(np.int64), np.frombuffer(row["words"], np.uint64), _unpress(row["codes"], np.int32).astype(np.int64)


def _split(hashes: np.ndarray, buckets: int):
    """Places of hashes by bucket: (bucket, places)."""
    b = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    names, starts = np.unique(b[order], return_index=True)
    return zip(names.tolist(), np.split(order, starts[1:]))


def _send(order: int, buckets: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                for n, (_, hashes, counts) in enumerate(grams(*_unpacked(row), order), 1):
                    out += [(b, n, row["block"], _keys(hashes[i], buckets), _press(counts[i].astype(np.uint32))) for b, i in _split(hashes, buckets)]
                if out:
                    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["bucket", "n", "block", "hashes", "counts"])

    return run


def _totals(batches):
    """Adds up the counts of each hash in a bucket, and answers each block in the order it asked."""
    now, held = None, []

    def out():
        cut = np.cumsum([len(h) for _, h, _ in held])[:-1]
        _, inverse = np.unique(np.concatenate([h for _, h, _ in held]), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([c for _, _, c in held])).astype(np.int64)[inverse]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
        rows = [(now[0], now[1], b, _press(t)) for (b, _, _), t in zip(held, np.split(total, cut))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["bucket", "n", "block", "totals"])

    for batch in batches:
        for b, n, block, h, c in zip(*(batch[x].to_pylist() for x in ("bucket", "n", "block", "hashes", "counts"))):
            if held and (b, n) != now:
                yield out()
                held = []
            now = (b, n)
            held.append((block, _unkeys(h), _unpress(c, np.uint32)))
    if held:
        yield out()


def _score(order: int, alpha: float, buckets: int, words_total: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lengths, words, codes = _unpacked(row)
                docs = np.repeat(np.arange(len(lengths)), lengths)
                answers = {(a["n"], a["bucket"]): _unpress(a["totals"], np.int64) for a in row["answers"] or ()}
                others = []  # for n: counts in other documents of the n-gram that begins at a place
                for n, (at, hashes, _) in enumerate(grams(lengths, words, codes, order), 1):
                    total = np.zeros(len(hashes), np.int64)
                    for b, i in _split(hashes, buckets):
                        total[i] = answers[n, b]
                    has = at >= 0
                    _, inverse, own = np.unique(docs[has] * max(1, len(hashes)) + at[has], return_inverse=True, return_counts=True)
                    x = np.zeros(len(codes), np.int64)
                    x[has] = total[at[has]] - own[inverse]
                    others.append(x)
                rest = np.maximum(1, words_total - lengths[docs])
                logs = np.where(others[0] > 0, np.log(np.maximum(1, others[0]) / rest), np.log(1 / (rest + 1)))
                back = np.zeros(len(codes), np.int64)  # steps back that a place has taken so far
                first = np.cumsum(lengths) - lengths
                place = np.arange(len(codes)) - first[docs]
                for n in range(2, order + 1):
                    # word i ends the n-gram that begins at i - n + 1
                    ends = np.flatnonzero(place >= n - 1)
                    c, h = others[n - 1][ends - n + 1], others[n - 2][ends - n + 1]
                    seen = c > 0
                    logs[ends] = np.where(seen, np.log(np.maximum(1, c) / np.maximum(1, h)), np.log(alpha) + logs[ends])
                    back[ends] = np.where(seen, 0, back[ends] + 1)
                k = len(lengths)
                sums, backs = np.bincount(docs, logs, k), np.bincount(docs, back > 0, k).astype(np.int64)
                mean = [round(float(s) / int(m), 6) if m else None for s, m in zip(sums, lengths)]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(lengths), pa.array(backs), pa.array(mean, pa.float64())], names=["id", "n_tokens", "n_backoff", "mean_log_score"])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA, block_words: int = BLOCK_WORDS, bucket_grams: int = 1_000_000) -> DataFrame:
    """(id, n_tokens, n_backoff, mean_log_score) of each row."""
    ws = Workspace(docs.sparkSession, "lm")
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    blocks = ws.save(d.mapInArrow(_code(block_words), _BLOCKS), "blocks")
    total = blocks.agg(F.sum("n")).first()[0] or 0
    buckets = max(64, -(-total * order // bucket_grams))  # so a bucket fits a task at any size
    # one block at a time: a block's row is large, so batches are of few rows
    sent = blocks.mapInArrow(_send(order, buckets), "bucket int, n int, block long, hashes binary, counts binary")
    totals = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket", "n").mapInArrow(_totals, "bucket int, n int, block long, totals binary")
    answers = totals.groupBy("block").agg(F.collect_list(F.struct("n", "bucket", "totals")).alias("answers"))  # as much as the block sent
    return blocks.join(answers, "block", "left").mapInArrow(_score(order, alpha, buckets, total), "id long, n_tokens long, n_backoff long, mean_log_score double")


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs).withColumnRenamed("id", "doc_id")


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, len(w) AS len, unnest(w) AS b, unnest(range(1, len(w) + 1)) AS pos FROM w),
p AS (SELECT *, lag(b) OVER (PARTITION BY doc_id ORDER BY pos) AS a FROM t),
n AS (SELECT sum(len(w))::BIGINT AS n FROM w),
u AS (SELECT b, count(*) AS c FROM t GROUP BY b), ud AS (SELECT doc_id, b, count(*) AS c FROM t GROUP BY ALL),
g AS (SELECT a, b, count(*) AS c FROM p WHERE a IS NOT NULL GROUP BY ALL),
gd AS (SELECT doc_id, a, b, count(*) AS c FROM p WHERE a IS NOT NULL GROUP BY ALL),
x AS (SELECT p.doc_id, p.a, u.c - ud.c AS uni, coalesce(g.c - gd.c, 0) AS bi, h.c - hd.c AS ctx, greatest(1, n.n - p.len) AS rest
  FROM p CROSS JOIN n JOIN u ON u.b = p.b JOIN ud ON ud.doc_id = p.doc_id AND ud.b = p.b
  LEFT JOIN g ON g.a = p.a AND g.b = p.b LEFT JOIN gd ON gd.doc_id = p.doc_id AND gd.a = p.a AND gd.b = p.b
  LEFT JOIN u h ON h.b = p.a LEFT JOIN ud hd ON hd.doc_id = p.doc_id AND hd.b = p.a),
s AS (SELECT doc_id, a IS NOT NULL AND bi = 0 AS back, CASE WHEN bi > 0 THEN ln(bi::DOUBLE / ctx) ELSE
    (CASE WHEN a IS NULL THEN 0 ELSE ln(0.4::DOUBLE) END) + (CASE WHEN uni > 0 THEN ln(uni::DOUBLE / rest) ELSE ln(1.0::DOUBLE / (rest + 1)) END) END AS l FROM x)
SELECT w.doc_id, len(w.w)::BIGINT AS n_tokens, coalesce(q.nb, 0)::BIGINT AS n_backoff, q.m AS mean_log_score
FROM w LEFT JOIN (SELECT doc_id, count(*) FILTER (back) AS nb, round(avg(l), 6) AS m FROM s GROUP BY doc_id) q ON q.doc_id = w.doc_id
"""
