"""Files that all machines of a cluster see: where they lie, how tasks read them, and how tasks publish what they wrote."""

from __future__ import annotations

import os
import posixpath
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage


def shared_folder(spark: SparkSession) -> str:
    """A new folder in that of spark.checkpoint.dir; where that is unset, in a temporary one in local mode, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: tables in between need a folder that all machines share")
        folder = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; a path without a scheme is local."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def files_of(path: str, suffix: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of a folder's files of that suffix by name, hidden ones and folders left out."""
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(at))
    held = [f for f in found if f.type == fs.FileType.File and f.base_name.endswith(suffix) and f.base_name[0] not in "._"]
    return [(f"{path.rstrip('/')}/{f.base_name}", f.size) for f in sorted(held, key=lambda f: f.base_name)]


@dataclass
class Published(WriterCommitMessage):
    """What a task wrote: the hidden name, the name that it gets, and facts for the summary."""

    hidden: str
    name: str
    facts: dict


class PartWriter(DataSourceArrowWriter):
    """Writes one file per task in two phases: tasks write hidden files of names of their own, and only when all are done the driver renames
    those that were committed. A task that runs again, or a failed job, leaves nothing under a visible name."""

    suffix = ".part"

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex[:8]
        system, at = opened(self.path)
        if not overwrite and system.get_file_info(at).type != fs.FileType.NotFound:
            raise FileExistsError(self.path)

    def encode(self, batches: Iterator) -> tuple[bytes | Iterator[bytes], dict] | None:
        """The content of a file, and facts about it; None for no file."""
        raise NotImplementedError

    def finish(self, facts: list[dict]) -> dict[str, bytes]:
        """Files besides the parts, by name."""
        return {}

    def write(self, iterator: Iterator) -> Published:
        from pyspark import TaskContext

        system, at = opened(self.path)
        system.create_dir(at)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        stem = f"part-{part:05d}-{self.job}"
        hidden = posixpath.join(at, f".{stem}-{attempt}{self.suffix}")
        made = self.encode(iterator)
        if made is None:
            return Published("", "", {})
        content, facts = made
        with system.open_output_stream(hidden) as out:
            for piece in [content] if isinstance(content, bytes) else content:
                out.write(piece)
        return Published(hidden, posixpath.join(at, stem + self.suffix), {"part": part, **facts})

    def commit(self, messages: list[Published | None]) -> None:
        system, at = opened(self.path)
        system.create_dir(at)
        done = [m for m in messages if m is not None and m.name]
        old = [f.path for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and not f.base_name.startswith(".")] if self.overwrite else []
        for m in done:
            system.move(m.hidden, m.name)
        for name, content in self.finish(sorted((m.facts for m in done), key=lambda f: f["part"])).items():
            with system.open_output_stream(posixpath.join(at, name)) as out:
                out.write(content)
            old = [p for p in old if posixpath.basename(p) != name]
        for p in old:
            system.delete_file(p)
        self._clear(system, at)

    def abort(self, messages: list[Published | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, system: fs.FileSystem, at: str) -> None:
        for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if f.base_name.startswith(".part-") and f"-{self.job}-" in f.base_name:
                system.delete_file(f.path)
