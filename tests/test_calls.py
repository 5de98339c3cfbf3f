import shutil

import pyarrow as pa
from pyspark.sql import functions as F

from tests.test_activity import placed
from treeloom.streaming import calls as K
from treeloom.streaming import windows as W

PIECE = "call string, seq long, name string, part string, pieces long, t string"
BATCHES = [
    [("a", 2, None, "}", 3, "2024-01-01 00:02:00"), ("a", 0, "find", "{", None, "2024-01-01 00:00:00"), ("b", 1, "b1", "y", None, "2024-01-01 00:00:00"), ("c", 0, "c", "1", 2, "2024-01-01 00:00:00"), (None, 1, "n", "n", None, "2024-01-01 00:00:00"), ("n", None, "n", "n", None, "2024-01-01 00:00:00")],
    [("a", 1, None, "x", None, "2024-01-01 00:01:00"), ("b", 0, "b0", "x", None, "2024-01-01 00:03:00"), ("c", 0, "c", "1", 2, "2024-01-01 00:04:00")],
    [("a", 1, None, "x", None, "2024-01-01 00:05:00"), ("c", 0, "c", "1", 2, "2024-01-01 00:05:00"), ("d", 0, None, None, 1, "2024-01-01 00:05:00")],
    [("z", 0, "z", "z", None, "2024-01-02 00:00:00")],
    [("b", 0, "new", "call", 1, "2024-01-02 00:00:00")],
]
WANT = [("a", "find", "{x}", 3, "complete"), ("b", "b1", "xy", 2, "timeout"), ("b", "new", "call", 1, "complete"), ("c", "c", "1", 1, "timeout"), ("d", None, "", 1, "complete")]


def _pieces(spark, folder):
    s = spark.readStream.schema(PIECE).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return s.withColumn("ts", F.col("t").cast("timestamp")).drop("t")


def _rows(out):
    return sorted(out.collect())


def test_pieces_in_any_order(spark, tmp_path):
    placed(spark, tmp_path, [spark.createDataFrame(b, PIECE) for b in BATCHES], "all")
    with K.state_store(spark):
        assert [tuple(r) for r in _rows(W.drain(K.folded(_pieces(spark, tmp_path / "all")), "calls"))] == WANT
    placed(spark, tmp_path, [spark.createDataFrame([], PIECE)], "none")
    with K.state_store(spark):
        assert W.drain(K.folded(_pieces(spark, tmp_path / "none")), "calls").count() == 0


def test_restart_gives_the_same_rows(spark, tmp_path):
    placed(spark, tmp_path, [spark.createDataFrame(b, PIECE) for b in BATCHES], "all")
    (tmp_path / "some").mkdir()
    at = str(tmp_path / "run")
    files = sorted((tmp_path / "all").glob("*"))
    with K.state_store(spark):
        for f in files[:2]:
            shutil.copy(f, tmp_path / "some")
        first = _rows(W.drain(K.folded(_pieces(spark, tmp_path / "some")), "calls", at=at))
        assert [r.call for r in first] == ["a"]
        for f in files[2:]:
            shutil.copy(f, tmp_path / "some")
        # a run that died after its last batch was put out but before it was marked as done: the batch runs again
        last = max((tmp_path / "run/state/commits").glob("[0-9]*"), key=lambda p: int(p.name))
        last.unlink()
        (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
        assert [tuple(r) for r in _rows(W.drain(K.folded(_pieces(spark, tmp_path / "some")), "calls", at=at))] == WANT


def test_pieces_of_a_bucket_come_as_few_rows(monkeypatch):
    rows = [(i % 3, f"c{i % 30}", i, None if i % 7 else "n", "é" * (i % 5) if i % 11 else None, None, i) for i in range(4000)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("bucket", "call", "seq", "name", "part", "pieces", "ms"), r)) for r in rows], pa.schema([("bucket", pa.int32()), *K._PIECES]))
    want = sorted(r[1:] for r in rows)
    for limits, most in (({}, 3), ({"GATHER": 1000}, 12), ({"BLOCK": 100}, 42), ({"BLOCK_CHARS": 50}, 4000)):
        with monkeypatch.context() as m:
            for name, value in limits.items():
                m.setattr(K, name, value)
            out = [r for b in K._packed(batch.slice(at, 500) for at in range(0, 4000, 500)) for r in b.to_pylist()]
        assert 3 <= len(out) <= most
        back = [(r["bucket"], K._table([r["data"]], K._PIECES)) for r in out]
        assert all(int(c[1:]) % 3 == bucket for bucket, t in back for c in t["call"].to_pylist())
        assert sorted((tuple(r.values()) for _, t in back for r in t.to_pylist()), key=lambda r: r[:2]) == sorted(want, key=lambda r: r[:2])


def test_calls_of_one_bucket(spark, tmp_path):
    """Many calls of one bucket over batches: each whole, though some are sent twice, end early or never end."""
    pieces = [(f"c{c}", s, f"n{s}" if s < 3 else None, f"<{c}.{s}>", 9 if c % 2 else None, "2024-01-01 00:00:00") for c in range(60) for s in range(9)]
    again = [(*p[:3], "", *p[4:]) for p in pieces[::4]]
    placed(spark, tmp_path, [spark.createDataFrame(b, PIECE) for b in (pieces[::2] + again, pieces[1::2], [("z", 0, None, "z", None, "2024-01-02 00:00:00")])], "all")
    with K.state_store(spark):
        out = [tuple(r) for r in _rows(W.drain(K.folded(_pieces(spark, tmp_path / "all"), buckets=1), "calls"))]
    assert out == sorted((f"c{c}", "n2", "".join(f"<{c}.{s}>" for s in range(9)), 9, "complete" if c % 2 else "timeout") for c in range(60))


def test_pieces_behind_the_watermark(spark, tmp_path):
    """One of a call that is held counts; one whose call is over by the watermark is left out."""
    at = lambda call, seq, t: [(call, seq, "n", str(seq), None, t)]
    batches = [at("a", 0, "2024-01-01 00:00:00"), at("z", 0, "2024-01-01 03:00:00"), at("z", 1, "2024-01-01 03:01:00"), at("a", 1, "2024-01-01 00:30:00"), at("z", 2, "2024-01-04 00:00:00"), at("z", 3, "2024-01-04 00:00:00"), at("q", 0, "2024-01-01 00:00:00"), at("z", 4, "2024-01-08 00:00:00")]
    placed(spark, tmp_path, [spark.createDataFrame(b, PIECE) for b in batches], "all")
    with K.state_store(spark):
        out = [tuple(r) for r in _rows(W.drain(K.folded(_pieces(spark, tmp_path / "all"), 86400), "calls"))]
    assert [r for r in out if r[0] != "z"] == [("a", "n", "01", 2, "timeout")]
