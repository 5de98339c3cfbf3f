import pytest
from pyspark.sql import functions as F

from treeloom.sources import sessions as S


def _messages(spark, rows):
    return spark.createDataFrame([(s, i, "user", f"m{i}") for i, s in enumerate(rows)], "session_id string, turn long, role string, content string").withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("turn")))


def _in_one_part(spark):
    """Three session ids that share a part."""
    ids = spark.range(2000).select(F.concat(F.lit("session-"), "id").alias("s")).groupBy(S.part_of(F.col("s"))).agg(F.sort_array(F.collect_list("s")).alias("s"))
    return ids.first().s[:3]


def test_killed_delete_loses_nothing(spark, tmp_path, monkeypatch):
    path, (a, b, _) = str(tmp_path / "chat"), _in_one_part(spark)
    assert S.load(spark, path).count() == 0 and S.delete(spark, path, a)["status"] == "warning"
    S.append(_messages(spark, [a, b, a, "other"]), path)
    before = sorted(S.load(spark, path).collect())

    def dies(*_):
        raise KeyboardInterrupt

    for step in ("_published", "_written"):
        with monkeypatch.context() as m:
            m.setattr(S, step, dies)
            with pytest.raises(KeyboardInterrupt):
                S.delete(spark, path, a)
        assert sorted(S.load(spark, path).collect()) == before
    old = S.load(spark, path)
    assert S.delete(spark, path, a) == {"status": "success", "deleted_messages": 2}
    assert sorted(old.collect()) == before == sorted(S.load(spark, path, 1).collect())
    assert sorted(r.session_id for r in S.load(spark, path).collect()) == sorted([b, "other"])
    assert S.vacuum(spark, path) == 0 and S.vacuum(spark, path, 0) == 2
    assert S.load(spark, path).count() == 2 and S.snapshot(spark, path)[0] == 2


def test_changes_in_between(spark, tmp_path, monkeypatch):
    path, (a, b, c) = str(tmp_path / "chat"), _in_one_part(spark)
    S.append(_messages(spark, [a, b, c, a]), path)
    write, runs = S._written, []

    def meanwhile(messages, at):
        out = write(messages, at)
        if not runs:
            runs.append(1)
            S.delete(spark, path, b)
            S.append(_messages(spark, [c, "other"]), path)
        return out

    monkeypatch.setattr(S, "_written", meanwhile)
    assert S.delete(spark, path, a) == {"status": "success", "deleted_messages": 2}
    assert sorted(r.session_id for r in S.load(spark, path).collect()) == sorted([c, c, "other"])


def test_a_number_is_given_once(spark, tmp_path):
    path = str(tmp_path / "chat")
    S.append(_messages(spark, ["session-1"]), path)
    assert not S._published(spark, path, 1, []) and S.load(spark, path).count() == 1
    with pytest.raises(S.Conflict):
        S._commit(spark, path, ["commit=x/part=1"], [])
    S.append(_messages(spark, [None, "session-2"]), path)
    assert S.delete(spark, path, "session-2")["deleted_messages"] == 1 and S.load(spark, path).count() == 2
    # deleting the last messages leaves an empty table
    assert S.delete(spark, path, "session-1")["deleted_messages"] == 1 and S.load(spark, path).where("session_id IS NOT NULL").count() == 0
