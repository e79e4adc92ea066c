"""Files as a Python data source that commits: one file for each row, all of a write or none.

``df.write.format("clip_files").mode("append").save(path)`` writes rows (``name``, ``content``). A task puts its
files into a new folder under ``path/data``; the driver then writes one manifest that names the
folders of all tasks that succeeded, and with that the write is there. Readers follow manifests
alone, so what a failed or repeated task wrote is never seen; a write that fails removes its folders.
``spark.read.format("clip_files").load(path)`` gives the committed files, a partition for each folder;
with the option ``content`` "false" their contents are null and not read.

``new_only`` leaves out rows whose file was committed before, so a run that was cut off goes on.
Names are relative paths without "..". A name that is written twice is read twice. Paths may be of any
file system that Arrow knows; a plain one is local to each machine, so on a cluster it must be shared.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "name string, content binary"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if urlparse(path).scheme else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, top = opened(self.path)
        folder, count = uuid.uuid4().hex, 0
        try:
            for row in iterator:
                name = row["name"]
                if not name or name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"not a name of a file: {name}")
                at = f"{top}/data/{folder}/{name}"
                store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(at) as out:
                    out.write(bytes(row["content"] or b""))
                count += 1
        except BaseException:
            remove(store, f"{top}/data/{folder}")
            raise
        return Written(folder, count)

    def commit(self, messages: list) -> None:
        store, top = opened(self.path)
        store.create_dir(f"{top}/manifests", recursive=True)
        name = uuid.uuid4().hex
        with store.open_output_stream(f"{top}/manifests/_{name}") as out:
            out.write(json.dumps([{"folder": m.folder, "files": m.files} for m in messages if m and m.files]).encode())
        store.move(f"{top}/manifests/_{name}", f"{top}/manifests/{name}.json")

    def abort(self, messages: list) -> None:
        store, top = opened(self.path)
        for m in messages:
            if m:
                remove(store, f"{top}/data/{m.folder}")


def remove(store: fs.FileSystem, folder: str) -> None:
    if store.get_file_info(folder).type == fs.FileType.Directory:
        store.delete_dir(folder)


@dataclass
class Folder(InputPartition):
    name: str


class FilesReader(DataSourceReader):
    def __init__(self, path: str, content: bool) -> None:
        self.path, self.content = path, content

    def partitions(self) -> list[InputPartition]:
        store, top = opened(self.path)
        found = []
        for f in store.get_file_info(fs.FileSelector(f"{top}/manifests", allow_not_found=True)):
            if f.base_name.endswith(".json"):
                with store.open_input_stream(f.path) as s:
                    found += [Folder(x["folder"]) for x in json.loads(s.read())]
        return found

    def read(self, partition: InputPartition | None) -> Iterator[tuple]:
        if not isinstance(partition, Folder):
            return
        store, top = opened(self.path)
        base = f"{top}/data/{partition.name}"
        for f in store.get_file_info(fs.FileSelector(base, recursive=True)):
            if f.type != fs.FileType.File:
                continue
            content = None
            if self.content:
                with store.open_input_stream(f.path) as s:
                    content = s.read()
            yield f.path[f.path.index(partition.name) + len(partition.name) + 1 :], content


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "clip_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return FilesReader(self.options["path"], self.options.get("content", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        if overwrite:
            raise ValueError("files are only added")
        return FilesWriter(self.options["path"])


def write_files(files: DataFrame, path: str) -> None:
    """Add files (``name``, ``content``): all or none."""
    files.sparkSession.dataSource.register(Files)
    files.select("name", "content").write.format("clip_files").mode("append").save(path)


def read_files(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    spark.dataSource.register(Files)
    return spark.read.format("clip_files").option("content", str(content).lower()).load(path)


def new_only(rows: DataFrame, path: str, name: str = "name") -> DataFrame:
    """Rows whose file isn't committed yet; their contents need not be made before."""
    done = read_files(rows.sparkSession, path, content=False).select("name").distinct()
    return rows.join(done.withColumnRenamed("name", name), name, "left_anti")
