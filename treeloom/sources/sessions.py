"""Chat sessions as a table of messages: append, read in order, delete with counts, list with filters.

Messages are (session_id string, turn long, role, content, ts), Parquet parted by a hash of the
session, so that reading or deleting one session touches one part of the table.

Files never change. A numbered manifest lists the folders that make up the table; a change writes
folders of its own first and then publishes the next number, which a rename that refuses to
overwrite gives to one writer alone. A reader sees the table before or after a change, and a change
that dies before its manifest leaves folders that no one reads, until ``vacuum``. Where a file
system's rename isn't atomic (object stores), one writer at a time may change a table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 64
MESSAGES = "session_id string, turn long, role string, content string, ts timestamp"


def part_of(session_id: Column) -> Column:
    return F.pmod(F.xxhash64(session_id), F.lit(PARTS)).cast("int")


class Conflict(Exception):
    """Another change took away folders that this one was made from."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[str]]:
    """The newest (or given) version's number and folders; 0 and none for a table without a manifest."""
    at, fs = _fs(spark, f"{path}/manifests")
    if version is None:
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        version = max((int(n) for n in names if n.isdigit()), default=0)
    if version == 0:
        return 0, []
    at, fs = _fs(spark, f"{path}/manifests/{version:012d}")
    stream = fs.open(at)
    try:
        return version, json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _published(spark: SparkSession, path: str, version: int, folders: list[str]) -> bool:
    """Whether the folders became the table's version; False if another change has that number."""
    draft, fs = _fs(spark, f"{path}/manifests/draft-{uuid.uuid4().hex}")
    final, _ = _fs(spark, f"{path}/manifests/{version:012d}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(folders).encode()))
    finally:
        out.close()
    jvm = spark._jvm
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, final, how)
    except Exception as e:
        fs.delete(draft, False)
        if fs.exists(final):
            return False
        raise e
    return True


def _commit(spark: SparkSession, path: str, gone: list[str], new: list[str]) -> int:
    """Publishes the newest version without the folders ``gone`` and with ``new``; what others added meanwhile stays."""
    while True:
        version, folders = snapshot(spark, path)
        if not set(gone) <= set(folders):
            raise Conflict(path)
        if _published(spark, path, version + 1, [f for f in folders if f not in set(gone)] + new):
            return version + 1


def _written(messages: DataFrame, path: str) -> list[str]:
    """Writes messages to folders that no manifest lists yet; their names."""
    spark, commit = messages.sparkSession, uuid.uuid4().hex
    at = f"{path}/data/commit={commit}"
    messages.withColumn("part", part_of(F.col("session_id"))).write.partitionBy("part").parquet(at)
    here, fs = _fs(spark, at)
    return sorted(f"commit={commit}/{f.getPath().getName()}" for f in fs.listStatus(here) if f.isDirectory() and f.getPath().getName().startswith("part="))


def _read(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], MESSAGES + ", part int")
    found = spark.read.schema(MESSAGES + ", commit string, part int").option("basePath", f"{path}/data").parquet(*(f"{path}/data/{f}" for f in folders))
    return found.drop("commit")


def append(messages: DataFrame, path: str) -> None:
    """Adds messages; appending the same twice holds them twice."""
    _commit(messages.sparkSession, path, [], _written(messages, path))


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The messages of the newest version, or of an earlier one."""
    return _read(spark, path, snapshot(spark, path, version)[1])


def history(messages: DataFrame, session_id: str) -> DataFrame:
    """A session's messages in order; of a loaded table one part is read."""
    out = messages.where(F.col("session_id") == session_id)
    return (out.where(F.col("part") == part_of(F.lit(session_id))) if "part" in messages.columns else out).orderBy("turn")


def matching(keys: DataFrame, pattern: str, key: str = "key") -> DataFrame:
    """Keys that a pattern with * and ? matches."""
    like = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_")
    return keys.where(F.col(key).like(like))


def delete(spark: SparkSession, path: str, session_id: str) -> dict:
    """Removes a session from a stored table by writing its part anew; status and number of messages gone.

    If another change takes the part meanwhile, the delete starts over from the new version. Messages
    that are added meanwhile stay. Older versions hold the messages until ``vacuum``.
    """
    if not session_id or len(session_id) < 5:
        return {"status": "error", "deleted_messages": 0}
    part = spark.range(1).select(part_of(F.lit(session_id)).alias("p")).first().p
    while True:
        own = [f for f in snapshot(spark, path)[1] if f.endswith(f"/part={part}")]
        rows = _read(spark, path, own)
        n = rows.where(F.col("session_id") == session_id).count()
        if n == 0:
            return {"status": "warning", "deleted_messages": 0}
        new = _written(rows.drop("part").where(~F.col("session_id").eqNullSafe(F.lit(session_id))), path)
        try:
            _commit(spark, path, own, new)
            return {"status": "success", "deleted_messages": n}
        except Conflict:
            continue


def vacuum(spark: SparkSession, path: str, older_than_s: float = 86400.0) -> int:
    """Deletes manifests before the newest and folders that it doesn't list, if they are older than a change may take; folders deleted."""
    version, folders = snapshot(spark, path)
    at, fs = _fs(spark, f"{path}/data")
    before, gone = spark._jvm.java.lang.System.currentTimeMillis() - older_than_s * 1000, 0
    for commit in fs.listStatus(at) if fs.exists(at) else []:
        for f in fs.listStatus(commit.getPath()):
            name = f"{commit.getPath().getName()}/{f.getPath().getName()}"
            if f.isDirectory() and name not in folders and f.getModificationTime() <= before:
                fs.delete(f.getPath(), True)
                gone += 1
    for f in fs.listStatus(_fs(spark, f"{path}/manifests")[0]) if version else []:
        name = f.getPath().getName()
        if (not name.isdigit() or int(name) < version) and f.getModificationTime() <= before:
            fs.delete(f.getPath(), False)
    return gone


def removed(keys: DataFrame, patterns: list[str], key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(keys that stay, (pattern, n) that go); a key counts under the first pattern that matches it."""
    first = F.coalesce(*(F.when(F.col(key).like(p.replace("_", "\\_").replace("*", "%")), p) for p in patterns))
    marked = keys.withColumn("pattern", first)
    return marked.where("pattern IS NULL").drop("pattern"), marked.where("pattern IS NOT NULL").groupBy("pattern").agg(F.count("*").alias("n"))


def status(idle_s: Column) -> Column:
    return F.when(idle_s < 300, "active").when(idle_s < 1800, "idle").otherwise("inactive")


def listed(messages: DataFrame, now: str, with_status: str = "all", search: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """(session_id, n_messages, status, started, last_activity, total, has_more): a page of sessions, those active last first.

    ``search`` is a part of the id, whatever its case; ``total`` counts the sessions of all pages.
    """
    s = messages.groupBy("session_id").agg(F.count("*").alias("n_messages"), F.min("ts").alias("started"), F.max("ts").alias("last_activity"))
    s = s.withColumn("status", status(F.lit(now).cast("timestamp").cast("double") - F.col("last_activity").cast("timestamp").cast("double")))
    if with_status != "all":
        s = s.where(F.col("status") == with_status)
    if search:
        s = s.where(F.lower("session_id").contains(search.lower()))
    page = s.orderBy(F.desc("last_activity"), "session_id").offset(offset).limit(limit)
    return page.crossJoin(s.agg(F.count("*").alias("total"))).select("*", (F.lit(offset + limit) < F.col("total")).alias("has_more"))
