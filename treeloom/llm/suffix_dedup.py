"""Suffix-array dedup: bytes in strings of ``length`` bytes that also start elsewhere are removed.

Candidates: every window of ``length`` bytes has an anchor, its ``GRAM``-byte string of the
smallest hash, so equal windows have equal anchors at the same place. A document falls into
runs of windows with one anchor. Anchors that occur once are dropped by two Bloom filters before anything
but hashes is shuffled; the runs of the others meet by anchor, equal runs as one.

Confirmation: the runs of one anchor, or of several, form a text whose Burrows-Wheeler order
(suffixes sorted to ``length`` symbols) is expanded breadth first: boundaries between
suffixes of common prefix l follow by one backward step from those of l - 1, so common
prefixes come by increasing value, and expansion stops at ``length``: suffixes not parted by then share a
string of that length. As every window of a document is in just one run, those are
different places.

Cases: a null text is empty; texts under ``length`` bytes lose nothing; matches never
cross documents; equal rows are different places, so both lose what they share; rows with
a null doc_id take part. Runs of one anchor beyond ``ANCHOR_BYTES`` aren't gathered: they are cut by the
place of the anchor in the window into parts whose windows share all but ``STEP`` bytes, and parts that
share those meet instead. Should even they pass the bound, windows are counted by their hashes in a shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import PACKED, Workspace, join_by_key, mix, pack_hashes, repeat_filter

LENGTH, GRAM, PIECE, TASK_BYTES = 200, 32, 1 << 19, 1 << 20
#: Bytes of one anchor that a task takes (its arrays are some 80 times that), and windows of a part of a run.
ANCHOR_BYTES, STEP = 4 << 20, 21
_MASK = np.uint64((1 << 20) - 1)
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _gram_hashes(data: bytes) -> np.ndarray:
    """A hash of each ``GRAM`` bytes (four words of 8)."""
    n = len(data) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for k, m in enumerate(_M):
        h += np.ndarray((n,), "<u8", data, 8 * k, (1,)) * m
    h ^= h >> np.uint64(32)
    h *= _M[1]
    return h ^ (h >> np.uint64(29))


def runs(data: bytes, length: int = LENGTH):
    """(start, end, anchor hash) arrays: windows that start in [start, end] have one anchor."""
    out = []
    span = length - GRAM + 1
    for at in range(0, len(data) - length + 1, PIECE):
        part = data[at : at + PIECE + length - 1]
        h = _gram_hashes(part)
        v = (h & ~_MASK) | np.arange(len(h), dtype=np.uint64)
        n = len(h) - span + 1
        pad = np.full(-len(v) % span, np.iinfo(np.uint64).max, np.uint64)
        b = np.concatenate([v, pad]).reshape(-1, span)
        left = np.minimum.accumulate(b, 1).ravel()
        right = np.minimum.accumulate(b[:, ::-1], 1)[:, ::-1].ravel()
        anchor = np.minimum(right[:n], left[span - 1 : span - 1 + n]) & _MASK
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.concatenate([first[1:], [n]]) - 1
        out.append((first + at, last + at, mix(h[anchor[first].astype(np.int64)])))  # mixed: smallest hashes have equal first bits
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _pack(length: int):
    def run(batches):
        for batch in batches:
            found = [runs((t.as_py() or "").encode(), length)[2] for t in batch["text"]]
            rows = list(pack_hashes(np.concatenate(found))) if found else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["seg", "n", "once", "again"])

    return run


def _occurrences(shared, length: int):
    """Runs with suspected anchors. Equal runs of a document are one row with all their starts."""

    def run(batches):
        repeats = shared.value
        for batch in batches:
            rows = []

            def out():
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary())
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["id", "th", "anchor", "run", "n", "starts", "data"])

            for i, th, t in zip(batch["id"].to_pylist(), batch["th"].to_pylist(), batch["text"]):
                data = (t.as_py() or "").encode()
                if len(data) < length:
                    continue
                first, last, h = runs(data, length)
                hit = repeats(h)
                mine: dict = {}
                for a, b, x in zip(first[hit].tolist(), last[hit].tolist(), h[hit].astype(np.int64).tolist()):
                    s = data[a : b + length]
                    mine.setdefault((x, xxhash.xxh3_128_digest(s + x.to_bytes(8, "little", signed=True))), (s, []))[1].append(a)
                rows += [(i, th, x, key, len(starts), starts, s) for (x, key), (s, starts) in mine.items()]
                if len(rows) >= 4000:
                    yield out()
                    rows = []
            if rows:
                yield out()

    return run


def repeated_starts(strings: list[bytes], length: int = LENGTH) -> np.ndarray:
    """For the strings one after another, each followed by a separator: does a window that repeats start here?"""
    text = np.concatenate([np.concatenate([np.frombuffer(s, np.uint8).astype(np.int64) + 1, [0]]) for s in strings])
    n = len(text)
    # suffixes in order of their first symbols: 7 at once, then twice as many each round
    padded = np.concatenate([text, np.zeros(7, np.int64)])
    key, known = np.zeros(n, np.int64), 7
    for k in range(7):
        key = (key << 9) | padded[k : k + n]
    while True:
        order = np.argsort(key)  # equal so far: any order will do
        k = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]]))
        if known >= length or rank[order[-1]] == n - 1:
            break
        nxt = np.zeros(n, np.int64)
        nxt[: max(0, n - known)] = rank[known:] + 1
        key, known = rank * (n + 1) + nxt, known * 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    # where the suffix one symbol on stands: a step back leads from there to here
    on = place[np.minimum(order + 1, n - 1)]
    low, high = np.minimum(on[:-1], on[1:]), np.maximum(on[:-1], on[1:])
    first = text[order]
    parted = np.zeros(n, bool)  # at p: the suffixes at p - 1 and p differ within the symbols so far
    parted[1:] = first[1:] != first[:-1]
    parted[0] = True
    # most ranges hold one boundary, which names the place that it parts; the others are searched for new boundaries
    at = np.flatnonzero(~parted)
    one = high[at - 1] - low[at - 1] == 1
    parts = np.full(n, -1)
    parts[high[at[one] - 1]] = at[one]
    wide = at[~one]
    new = np.flatnonzero(parted)
    for _ in range(1, length):
        a = parts[new]
        a = a[a >= 0]
        inside = np.searchsorted(new, high[wide - 1], "right") > np.searchsorted(new, low[wide - 1], "right")
        new = np.sort(np.concatenate([a, wide[inside]]))
        if not len(new):
            break  # nothing has just this common prefix, so nothing has a longer one that ends
        parted[new] = True
        wide = wide[~inside]
    open_ = np.flatnonzero(~parted)
    out = np.zeros(n, bool)
    out[order[open_]] = True
    out[order[open_ - 1]] = True
    return out


def _covered(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs [begin, end) of bytes in windows at the sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    a = starts[np.concatenate([[0], cut + 1])]
    b = starts[np.concatenate([cut, [len(starts) - 1]])] + length
    return list(zip(a.tolist(), b.tolist()))


def _as_bytes(spans: list[tuple[int, int]]) -> bytes:
    return np.array(spans, np.int32).tobytes()


def _judge(length: int, task_bytes: int):
    """Spans of each distinct run that repeat; anchors come whole, several in one text."""

    def run(batches):
        held, size, anchor = [], 0, None

        def out():
            flags = repeated_starts([d for _, _, d in held], length)
            at, rows = 0, []
            for key, n, d in held:
                own = np.flatnonzero(flags[at : at + len(d) - length + 1])
                at += len(d) + 1
                spans = [(0, len(d))] if n > 1 else _covered(own, length)
                if spans:
                    rows.append((key, _as_bytes(spans)))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (zip(*rows) if rows else ((), ()))], names=["run", "spans"])

        for batch in batches:
            for a, key, n, d in zip(*(batch[c].to_pylist() for c in ("anchor", "run", "n", "data"))):
                if size >= task_bytes and a != anchor:
                    yield out()
                    held, size = [], 0
                anchor = a
                held.append((key, n, d))
                size += len(d)
        if held:
            yield out()

    return run


def _parts(length: int, step: int = STEP):
    """Runs of too frequent anchors by parts: windows that hold their anchor at places of one class of ``step``.

    Equal windows hold their anchors at equal places, so they are in parts of one class that share the
    bytes which all windows of the class hold; a hash of those is the part's own anchor.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for a, key, n, d in zip(*(batch[c].to_pylist() for c in ("anchor", "run", "n", "data"))):
                last = len(d) - length
                h = mix(_gram_hashes(d)).astype(np.int64)
                p = last + int(np.flatnonzero(h[last:] == a)[0])
                for j in range((p - last) // step, p // step + 1):
                    first, end = max(0, p - j * step - step + 1), min(last, p - j * step)
                    part = d[first : end + length]
                    name = b"%d %d " % (a, j)
                    held = d[p - j * step : p - j * step + length - step + 1]
                    own = int.from_bytes(xxhash.xxh3_64_digest(name + held), "little", signed=True)
                    rows.append((own, key, first, xxhash.xxh3_128_digest(name + held + part), n, part))
            if rows:
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["anchor", "whole", "at", "run", "n", "data"])

    return run


def _windows(length: int):
    def run(batches):
        for batch in batches:
            for key, d in zip(batch["run"].to_pylist(), batch["data"].to_pylist()):
                w = [xxhash.xxh3_128_digest(d[i : i + length]) for i in range(len(d) - length + 1)]
                yield pa.RecordBatch.from_pydict({"window": pa.array(w, pa.binary()), "run": pa.array([key] * len(w), pa.binary()), "at": pa.array(range(len(w)), pa.int64())})

    return run


def _spans(length: int):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["run"], pa.array([_as_bytes(_covered(np.sort(np.array(x)), length)) for x in batch["at"].to_pylist()], pa.binary())], names=["run", "spans"])

    return run


def _merge(pieces) -> list[tuple[int, int]]:
    """Union of the spans of (starts, spans) pairs, as maximal runs."""
    marks = []
    for p in pieces:
        s = np.frombuffer(p["spans"], np.int32).reshape(1, -1, 2).astype(np.int64) + np.array(p["starts"], np.int64)[:, None, None]
        marks.append(s.reshape(-1, 2))
    if not marks:
        return []
    m = np.concatenate(marks)
    m = m[np.argsort(m[:, 0], kind="stable")]
    upto = np.maximum.accumulate(m[:, 1])
    new = np.concatenate([[True], m[1:, 0] > upto[:-1]])
    at = np.flatnonzero(new)
    return list(zip(m[at, 0].tolist(), upto[np.concatenate([at[1:], [len(m)]]) - 1].tolist()))


def _cut(batches):
    for batch in batches:
        kept, n, removed, spans_n = [], [], [], []
        for t, pieces in zip(batch["text"], batch["pieces"]):
            data = (t.as_py() or "").encode()
            spans = _merge(pieces.as_py() or ())
            parts, at = [], 0
            for a, b in spans:
                parts.append(data[at:a])
                at = b
            parts.append(data[at:])
            kept.append(b"".join(parts))
            n.append(len(data))
            spans_n.append(len(spans))
            removed.append(len(data) - len(kept[-1]))
        yield pa.RecordBatch.from_arrays([batch["row"], pa.array(kept, pa.binary()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans_n, pa.int64())], names=["row", "kept", "n_bytes", "n_removed", "n_spans"])


def _confirmed(rows: DataFrame, ws: Workspace, length: int, task_bytes: int) -> DataFrame:
    """(run, spans) of what repeats in runs (anchor, run, n, data) whose anchors fit a task."""
    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_judge(length, task_bytes), "run binary, spans binary")


def _frequent(rows: DataFrame, ws: Workspace, length: int, anchor_bytes: int, task_bytes: int) -> DataFrame:
    """(run, at, spans) of what repeats in runs whose anchors don't fit a task: spans count from ``at`` in the run."""
    parts = ws.save(rows.mapInArrow(_parts(length), "anchor long, whole binary, at long, run binary, n long, data binary"), "parts")
    kinds = ws.save(parts.groupBy("run").agg(F.min("anchor").alias("anchor"), F.sum("n").alias("n"), F.count("*").alias("rows"), F.min("data").alias("data")), "part-kinds")
    size = kinds.groupBy("anchor").agg(F.sum(F.length("data")).alias("bytes"))
    kinds = ws.save(kinds.join(size, "anchor"), "part-sizes")
    judged = _confirmed(kinds.where(F.col("bytes") <= anchor_bytes).drop("bytes", "rows"), ws, length, task_bytes)
    many = ws.save(kinds.where(F.col("bytes") > anchor_bytes).mapInArrow(_windows(length), "window binary, run binary, at long"), "windows")
    twice = ws.save(many.groupBy("window").agg(F.count("*").alias("rows")).where("rows > 1"), "twice")
    counted = join_by_key(many, twice, "window", "rows").groupBy("run").agg(F.collect_list("at").alias("at")).mapInArrow(_spans(length), "run binary, spans binary")
    copied = kinds.where((F.col("n") > 1) & (F.col("bytes") > anchor_bytes)).select("run", F.lit(None).cast("binary").alias("spans"))
    verdict = ws.save(judged.unionByName(counted).unionByName(copied).join(kinds.select("run", "rows", F.length("data").alias("size")), "run"), "part-verdicts")
    verdict = verdict.select("run", "rows", F.coalesce("spans", _whole("size")).alias("spans"))
    return join_by_key(parts.select("whole", "at", "run"), verdict, "run", "rows").select(F.col("whole").alias("run"), "at", "spans")


def _whole(size: str):
    """The span (0, size), as two little-endian integers."""
    return F.expr(f"unhex(concat('00000000', hex(reverse(unhex(lpad(hex({size}), 8, '0'))))))")


def repeated_spans(d: DataFrame, ws: Workspace, length: int, anchor_bytes: int, task_bytes: int) -> DataFrame:
    """(id, th, pieces) of documents with repeats, from (id, th, text)."""
    spark = d.sparkSession
    packed = ws.save(d.select("text").mapInArrow(_pack(length), PACKED), "anchors")
    shared = spark.sparkContext.broadcast(repeat_filter(ws, packed))
    ws.drop(packed)
    occ = ws.save(d.mapInArrow(_occurrences(shared, length), "id long, th long, anchor long, run binary, n long, starts array<long>, data binary"), "runs")
    shared.destroy()
    kinds = ws.save(occ.groupBy("anchor", "run").agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.max(F.length("data")).alias("size")), "kinds")
    per = ws.save(kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("rows").alias("rows"), F.sum("n").alias("total"), F.sum("size").alias("bytes")).where("total > 1"), "per")
    # anchors with runs of several kinds: one row of each kind is confirmed, with its bytes
    several = per.where("kinds > 1").select("anchor", "bytes", "rows")
    rows = join_by_key(occ.select("anchor", "run", "data"), several, "anchor", "rows").dropDuplicates(["run"])
    rows = ws.save(rows.join(kinds.select("run", "n"), "run").select("anchor", "run", "n", "data", "bytes"), "distinct")
    zero, none = F.lit(0).cast("long").alias("at"), F.lit(None).cast("binary").alias("spans")
    judged = _confirmed(rows.where(F.col("bytes") <= anchor_bytes).drop("bytes"), ws, length, task_bytes).select("run", zero, "spans")
    hot = rows.where(F.col("bytes") > anchor_bytes).drop("bytes")
    alone = kinds.join(per.where("kinds = 1").select("anchor"), "anchor", "left_semi").select("run", zero, none)
    copied = hot.where("n > 1").select("run", zero, none)
    verdict = judged.unionByName(alone).unionByName(copied)
    if not hot.isEmpty():
        verdict = verdict.unionByName(_frequent(hot, ws, length, anchor_bytes, task_bytes))
    verdict = ws.save(verdict.join(kinds.select("run", F.col("rows").alias("rows")), "run"), "verdicts")
    hits = join_by_key(occ.select("id", "th", "run", "starts", F.length("data").alias("size")), verdict, "run", "rows")
    starts = F.transform("starts", lambda s: s + F.col("at")).alias("starts")
    return hits.select("id", "th", F.struct(starts, F.coalesce("spans", _whole("size")).alias("spans")).alias("piece")).groupBy("id", "th").agg(F.collect_list("piece").alias("pieces"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor_bytes: int = ANCHOR_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The rows with ``kept binary``, n_bytes, n_removed and n_spans, without ``text_col``; columns of these names are replaced."""
    ws = Workspace(docs.sparkSession, "suffix_dedup")
    new = ("kept", "n_bytes", "n_removed", "n_spans")
    rest = [c for c in docs.columns if c != text_col and c not in new]
    th = F.xxhash64(text_col)
    d = docs.select(F.col(id_col).cast("long").alias("id"), th.alias("th"), F.col(text_col).alias("text"))
    found = repeated_spans(d, ws, length, anchor_bytes, task_bytes).select(F.col("id").alias("_id"), F.col("th").alias("_th"), "pieces")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), F.col(id_col).cast("long").alias("_i"), th.alias("_t"), F.col(text_col).alias("text"))
    joined = rows.join(found, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_th")), "left").select("row", "text", "pieces")
    out = joined.mapInArrow(_cut, joined.select("row").schema.add("kept", "binary").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long"))
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in rest), *new)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) by counting all windows in memory; for tests."""
    from collections import Counter

    data = [(t or "").encode() for t in texts]
    count = Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for x in data:
        spans = _covered(np.array([i for i in range(len(x) - length + 1) if count[x[i : i + length]] > 1], np.int64), length)
        gone = np.zeros(len(x), bool)
        for a, b in spans:
            gone[a:b] = True
        out.append((len(x), int(gone.sum()), len(spans), hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~gone])).hexdigest()))
    return out
