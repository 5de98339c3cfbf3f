"""Calls that arrive in pieces, folded into one row each with state of any kind and event-time timers.

Pieces are kept in the state store as they come, in any order. A call leaves as soon as it holds as
many pieces as it says it has, or once no piece has come for a while by the watermark. TTL works by
the clock of the machine only, so an event-time timer also ends the mark that a complete call leaves behind.

A Python worker pays about the same for each access to the store, for each key and for each row that Spark hands it, whatever
they hold. So calls are dealt by a hash to buckets, whose number is fixed: the tasks that read pieces pack those of a bucket into
blocks (Arrow, as bytes), the store has a key for each bucket and keeps blocks as they are, calls come out as blocks that
the next step unpacks, and a bucket has one timer, that of the first of its calls to end.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Keys of the state; a checkpoint stays with the number that it began with.
BUCKETS = 1024
#: Rows of a block, and characters after which it ends.
BLOCK, BLOCK_CHARS = 1 << 16, 4 << 20
#: Rows and bytes that a task gathers before it packs them.
GATHER, GATHER_BYTES = 250_000, 32 << 20

BLOCKS = "data binary"
CALL = "call string, name string, arguments string, n_pieces long, outcome string"

_PIECES = pa.schema({"call": pa.string(), "seq": pa.int64(), "name": pa.string(), "part": pa.string(), "pieces": pa.int64(), "ms": pa.int64()})
_HEADS = pa.schema({"call": pa.string(), "held": pa.int64(), "pieces": pa.int64(), "until": pa.int64(), "closed": pa.bool_()})
_CALLS = pa.schema({"call": pa.string(), "name": pa.string(), "arguments": pa.string(), "n_pieces": pa.int64(), "outcome": pa.string()})

_Block = Row("data")


def _blocks(rows: pa.Table, long: str) -> Iterator[bytes]:
    """A table in blocks of bounded rows and, but for the last row of each, characters of the column ``long``."""
    if not rows.num_rows:
        return
    rows = rows.combine_chunks()
    chars = np.cumsum(pc.fill_null(pc.binary_length(rows[long]), 0).to_numpy())
    at = 0
    while at < rows.num_rows:
        end = np.searchsorted(chars, (chars[at - 1] if at else 0) + BLOCK_CHARS) + 1
        n = int(min(end - at, BLOCK))
        for batch in rows.slice(at, n).to_batches():
            yield batch.serialize().to_pybytes()
        at += n


def _table(blocks, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(b), schema) for b in blocks], schema)


def _of(rows: pa.Table, calls, within: bool = True) -> pa.Table:
    """The rows of some calls, or those of the others."""
    found = pc.is_in(rows["call"], value_set=pa.array(calls, pa.string()))
    return rows.filter(found if within else pc.invert(found))


def _packed(batches) -> Iterator[pa.RecordBatch]:
    """Pieces (bucket, ...) as a row for each block of a bucket."""

    def out(held):
        rows = pa.Table.from_batches(held)
        bucket = rows["bucket"].to_numpy()
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows.drop_columns("bucket").cast(_PIECES).take(order).combine_chunks(), bucket[order]
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        names, data = [], []
        for at, end in zip(cuts, cuts[1:]):
            for block in _blocks(rows.slice(at, end - at), "part"):
                names.append(bucket[at])
                data.append(block)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])

    held, n, size = [], 0, 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n, size = n + batch.num_rows, size + batch.nbytes
        if n >= GATHER or size >= GATHER_BYTES:
            yield out(held)
            held, n, size = [], 0, 0
    if held:
        yield out(held)


def _unpacked(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in batch["data"]:
            yield pa.ipc.read_record_batch(block.as_buffer(), _CALLS)


def _starts(*columns) -> np.ndarray:
    """Whether a row differs from the one before it in any of the columns."""
    new = np.ones(len(columns[0]), bool)
    if len(new) > 1:
        new[1:] = np.any([pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in columns], axis=0)
    return new


def _distinct(pieces: pa.Table) -> pa.Table:
    """The pieces by call and seq; of several with one seq the greatest by name, then part."""
    if not pieces.num_rows:
        return pieces
    keys = pa.table({"call": pieces["call"], "seq": pieces["seq"], "name": pc.fill_null(pieces["name"], ""), "part": pc.fill_null(pieces["part"], ""), "named": pc.cast(pc.is_valid(pieces["name"]), pa.int8())})
    out = pieces.take(pc.sort_indices(keys, [(c, "ascending") for c in keys.column_names])).combine_chunks()
    last = np.append(_starts(*(out[c].combine_chunks() for c in ("call", "seq")))[1:], True)
    return out.filter(pa.array(last))


def _calls(whole: pa.Table, outcome: str) -> Iterator[Row]:
    """Blocks of the calls of distinct pieces."""
    if not whole.num_rows:
        return
    call, name, part = (whole[c].combine_chunks() for c in ("call", "name", "part"))
    at = np.flatnonzero(_starts(call))
    end = np.append(at[1:], len(call))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(at, len(call)), pa.int32()), pc.fill_null(part, "")), "")
    named = np.maximum.accumulate(np.where(name.is_valid().to_numpy(zero_copy_only=False), np.arange(len(name)), -1))[end - 1]
    names = name.take(pa.array(np.maximum(named, 0), mask=named < at))
    rows = pa.Table.from_arrays([call.take(pa.array(at)), names, joined, pa.array(end - at, pa.int64()), pa.array([outcome] * len(at), pa.string())], schema=_CALLS)
    for block in _blocks(rows, "arguments"):
        yield _Block(block)


class CallFold(StatefulProcessor):
    """Folds blocks (bucket, data) of the pieces of a bucket of calls, each call by itself.

    A head is [pieces held, pieces that the call has, when it ends, whether it is complete].
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", BLOCKS)
        self.heads = handle.getValueState("heads", BLOCKS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        heads = self._heads()
        timer = min((h[2] for h in heads.values()), default=None)
        kept = None  # stored pieces, once they have been read
        if timer is not None and timer <= now:
            # over by the watermark, but rows of a batch come before its timers
            ended, kept = self._ended(heads, self._kept(), now)
            yield from ended
        new = _table([bytes(r.data) for r in rows], _PIECES)
        came = new.group_by("call").aggregate([("seq", "count"), ("pieces", "max"), ("ms", "max")])
        count, left = {}, []
        for call, n, pieces, ms in zip(*(came[c].to_pylist() for c in ("call", "seq_count", "pieces_max", "ms_max"))):
            head = heads.get(call)
            if head[3] if head else ms + self.idle_ms <= now:
                left.append(call)  # complete, or over by the watermark before it came
                continue
            if head is None:
                head = heads[call] = [0, None, now + 1, False]
            count[call] = n
            head[0] += n
            head[2] = max(head[2], ms + self.idle_ms)
            if pieces is not None:
                head[1] = pieces if head[1] is None else max(head[1], pieces)
        if left:
            new = _of(new, left, within=False)
        full = [c for c in count if heads[c][1] is not None and heads[c][0] >= heads[c][1]]
        if full:
            whole, new = _of(new, full), _of(new, full, within=False)
            if kept is None and any(heads[c][0] > count[c] for c in full):
                kept = self._kept()
            if kept is not None:
                whole, kept = pa.concat_tables([_of(kept, full), whole]), _of(kept, full, within=False)
            whole = _distinct(whole)
            some = whole.group_by("call").aggregate([("seq", "count")])
            complete = []
            for c, n in zip(some["call"].to_pylist(), some["seq_count"].to_pylist()):
                if n >= heads[c][1]:
                    heads[c][0], heads[c][3] = 0, True
                    complete.append(c)
                else:
                    heads[c][0] = n
            yield from _calls(_of(whole, complete), "complete")
            new = pa.concat_tables([_of(whole, complete, within=False), new])
        if kept is not None:
            self.parts.clear()
            new = pa.concat_tables([kept, new])
        self._append(new)
        self._keep_heads(heads, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        heads = self._heads()
        ended, kept = self._ended(heads, self._kept(), timerValues.getCurrentWatermarkInMs())
        yield from ended
        self.parts.clear()
        self._append(kept)
        self._keep_heads(heads, None)  # the timer is gone

    def close(self) -> None:
        pass

    @staticmethod
    def _ended(heads: dict, kept: pa.Table, now: int) -> tuple[Iterator[Row], pa.Table]:
        """Takes out the calls that are over: their rows, and the pieces of the others."""
        over = [c for c, h in heads.items() if h[2] <= now]
        open_ = [c for c in over if not heads[c][3]]
        for c in over:
            del heads[c]
        return _calls(_distinct(_of(kept, open_)), "timeout"), _of(kept, over, within=False)

    def _heads(self) -> dict[str, list]:
        state = self.heads.get()
        return {c: h for c, *h in zip(*(x.to_pylist() for x in _table([bytes(state[0])], _HEADS).columns))} if state else {}

    def _kept(self) -> pa.Table:
        return _table([bytes(block[0]) for block in self.parts.get()], _PIECES)

    def _append(self, pieces: pa.Table) -> None:
        for block in _blocks(pieces, "part"):
            self.parts.appendValue((block,))

    def _keep_heads(self, heads: dict, timer: int | None) -> None:
        """``timer`` is the one that is set."""
        first = min((h[2] for h in heads.values()), default=None)
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first is not None and timer != first:
            self.handle.registerTimer(first)
        if heads:
            columns = [list(heads), *map(list, zip(*heads.values()))]
            self.heads.update((pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _HEADS)], schema=_HEADS).serialize().to_pybytes(),))
        else:
            self.heads.clear()


def folded(deltas: DataFrame, idle_s: int = 3600, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """(call, name, arguments, n_pieces, outcome) of a stream of pieces (call, seq, name, part, pieces, ts).

    ``pieces`` is the number of pieces of the call, null where a piece doesn't know it. A call is
    ``complete`` when it holds that many, or a ``timeout`` once the watermark is ``idle_s`` past its
    last piece; pieces of a complete call that come until then are left out, later ones are a new
    call. Pieces behind the watermark count, unless their call isn't held and the watermark is ``idle_s`` past all of them that a batch
    brings. The last name that isn't null wins, parts are joined by seq, a piece sent twice counts once. Pieces without call, seq or ts are left out. The pieces held of a bucket of calls fit a task,
    so raise ``buckets`` for streams that hold hundreds of millions of calls.
    """
    bucket = F.pmod(F.xxhash64("call"), F.lit(buckets)).cast("int").alias("bucket")
    d = deltas.where("call IS NOT NULL AND seq IS NOT NULL AND ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select(
        bucket, F.col("call").cast("string").alias("call"), F.col("seq").cast("long").alias("seq"), F.col("name").cast("string").alias("name"), F.col("part").cast("string").alias("part"), F.col("pieces").cast("long").alias("pieces"), F.unix_millis("ts").alias("ms")
    )
    blocks = d.mapInArrow(_packed, f"bucket int, {BLOCKS}").groupBy("bucket").transformWithState(CallFold(idle_s * 1000), BLOCKS, "append", "EventTime")
    return blocks.mapInArrow(_unpacked, CALL)


@contextmanager
def state_store(spark: SparkSession):
    """The session with the state store that such folds need; what was set before comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
