import json

import pytest
from pyspark.sql import functions as F

from tests.test_activity import placed
from treeloom.sources import frames as L

ROWS = "i long, frame string"


def _log(spark, path):
    return sorted((r["commit"], r.frame) for r in spark.read.format("frame_log").load(path).collect())


def _write(spark, source, path, state):
    s = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(source)
    s.writeStream.format("frame_log").option("checkpointLocation", state).trigger(availableNow=True).start(path).awaitTermination()


def test_batches_run_again(spark, tmp_path):
    spark.dataSource.register(L.FrameLog)
    long = json.dumps({"x": "ä" * 3_000_000}, ensure_ascii=False)
    tables = [[(1, '{"a": 1}'), (2, '{\n"b":\r\n2}'), (3, None)], [(4, '{"a": 1}'), (5, long)], [(6, None)], [(7, "{}")]]
    placed(spark, tmp_path, [spark.createDataFrame(t, ROWS) for t in tables], "in")
    source, path, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    _write(spark, source, path, state)
    want = sorted([(0, '{"a": 1}'), (0, '{ "b":  2}'), (1, '{"a": 1}'), (1, long), (3, "{}")])
    assert _log(spark, path) == want
    # a reader that has seen all so far, then a writer whose last batch was put out but not marked as done
    out, seen = str(tmp_path / "out"), str(tmp_path / "seen")
    copy = lambda: spark.readStream.format("frame_log").load(path).writeStream.format("parquet").option("checkpointLocation", seen).trigger(availableNow=True).start(out).awaitTermination()
    copy()
    last = max((tmp_path / "state/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    files = len(list((tmp_path / "log/files").iterdir()))
    _write(spark, source, path, state)
    assert _log(spark, path) == want and len(list((tmp_path / "log/files").iterdir())) == files
    placed(spark, tmp_path, [spark.createDataFrame([(8, '{"new": 1}')], ROWS)], "more")
    next((tmp_path / "more").iterdir()).rename(tmp_path / "in/9.parquet")
    _write(spark, source, path, state)
    copy()
    copy()
    read = sorted((r["commit"], r.frame) for r in spark.read.parquet(out).collect())
    assert read == _log(spark, path) == sorted([*want, (4, '{"new": 1}')])


def test_aborted_files_are_not_read(spark, tmp_path):
    spark.dataSource.register(L.FrameLog)
    path = str(tmp_path / "log")
    assert _log(spark, path) == []
    w = L.FrameWriter(path, 0)
    kept, lost = w.write(iter([("1",)])), w.write(iter([("2",)]))
    w.commit([kept, None], 0)
    w.abort([lost], 1)
    dead = w.write(iter([("3",)]))  # its task's driver died
    assert dead.n == 1 and _log(spark, path) == [(0, "1")]
    w.commit([w.write(iter([("1",)]))], 0)
    assert _log(spark, path) == [(0, "1")] and w.write(iter([(None,)])).name is None
    with pytest.raises(Exception):
        spark.readStream.format("rate").load().select(F.col("value")).writeStream.format("frame_log").option("checkpointLocation", str(tmp_path / "s")).start(path).awaitTermination()
