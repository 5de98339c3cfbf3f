"""JSON frames in a folder as a Python data source, written and read by streams or batches.

    spark.dataSource.register(FrameLog)
    frames.writeStream.format("frame_log").option("checkpointLocation", at).start(path)
    spark.readStream.format("frame_log").load(path)

A micro-batch's tasks write files of their own, and the driver then publishes one commit that names
them. A batch that is run again finds its commit and leaves it as it is, and files that no commit
names are never read: no frame is lost or doubled. One stream writes to a folder. Offsets of
readers are numbers of commits. Paths are those of Arrow's file systems (local, hdfs, s3, gs).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType


class Folder:
    """Files and commits below a path; tasks and driver open it for themselves."""

    def __init__(self, path: str):
        self.path = path

    def _open(self):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.path)
        return system, base.rstrip("/")

    def put(self, frames) -> Written:
        """Writes frames, one a line, to a new file; nulls are left out."""
        system, base = self._open()
        system.create_dir(f"{base}/files", recursive=True)
        name, n = uuid.uuid4().hex, 0
        with system.open_output_stream(f"{base}/files/{name}") as out:
            for frame in frames:
                if frame is not None:
                    # in JSON a bare line end can only stand between tokens
                    out.write(frame.replace("\r", " ").replace("\n", " ").encode() + b"\n")
                    n += 1
        if n == 0:
            system.delete_file(f"{base}/files/{name}")
        return Written(name if n else None, n)

    def lines(self, name: str) -> Iterator[str]:
        system, base = self._open()
        rest = b""
        with system.open_input_stream(f"{base}/files/{name}") as source:
            while piece := source.read(1 << 20):
                *whole, rest = (rest + piece).split(b"\n")
                for line in whole:
                    yield line.decode()

    def drop(self, written) -> None:
        system, base = self._open()
        for w in written:
            if w is not None and w.name is not None:
                system.delete_file(f"{base}/files/{w.name}")

    def commits(self) -> list[int]:
        from pyarrow import fs

        system, base = self._open()
        found = system.get_file_info(fs.FileSelector(f"{base}/commits", allow_not_found=True))
        return sorted(int(f.base_name) for f in found if f.base_name.isdigit())

    def names(self, commit: int) -> list[str]:
        system, base = self._open()
        with system.open_input_stream(f"{base}/commits/{commit:012d}") as source:
            return json.loads(source.read())

    def publish(self, commit: int, written) -> None:
        """Makes the files part of the log; those of a commit that is there already are deleted instead."""
        if commit in self.commits():
            self.drop(written)
            return
        system, base = self._open()
        system.create_dir(f"{base}/commits", recursive=True)
        draft = f"{base}/commits/draft-{uuid.uuid4().hex}"
        with system.open_output_stream(draft) as out:
            out.write(json.dumps([w.name for w in written if w is not None and w.name is not None]).encode())
        system.move(draft, f"{base}/commits/{commit:012d}")


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    n: int


@dataclass
class File(InputPartition):
    commit: int
    name: str


class FrameWriter(DataSourceStreamWriter):
    def __init__(self, path: str, column: int):
        self.folder, self.column = Folder(path), column

    def write(self, iterator) -> Written:
        return self.folder.put(row[self.column] for row in iterator)

    def commit(self, messages, batchId: int) -> None:
        self.folder.publish(batchId, messages)

    def abort(self, messages, batchId: int) -> None:
        if batchId not in self.folder.commits():
            self.folder.drop(messages)


class FrameReader(DataSourceReader):
    """All commits there are."""

    def __init__(self, path: str):
        self.folder = Folder(path)

    def _files(self, commits) -> list[File]:
        return [File(c, name) for c in commits for name in self.folder.names(c)]

    def partitions(self) -> list[File]:
        return self._files(self.folder.commits()) or [File(-1, "")]

    def read(self, partition: File) -> Iterator[tuple]:
        if partition.name:
            for line in self.folder.lines(partition.name):
                yield partition.commit, line


class FrameStreamReader(FrameReader, DataSourceStreamReader):
    """Commits after the last offset; a file is a task's work."""

    def initialOffset(self) -> dict:
        return {"commit": -1}

    def latestOffset(self) -> dict:
        return {"commit": max(self.folder.commits(), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[File]:
        return self._files(c for c in self.folder.commits() if start["commit"] < c <= end["commit"]) or [File(-1, "")]

    def commit(self, end: dict) -> None:
        pass


class FrameLog(DataSource):
    """Format ``frame_log``: reads (commit, frame), writes the column ``frame``."""

    @classmethod
    def name(cls) -> str:
        return "frame_log"

    def schema(self) -> str:
        return "commit long, frame string"

    def reader(self, schema: StructType) -> FrameReader:
        return FrameReader(self.options["path"])

    def streamReader(self, schema: StructType) -> FrameStreamReader:
        return FrameStreamReader(self.options["path"])

    def streamWriter(self, schema: StructType, overwrite: bool) -> FrameWriter:
        if "frame" not in schema.names:
            raise ValueError("frame_log writes a column 'frame' of JSON texts")
        return FrameWriter(self.options["path"], schema.names.index("frame"))
