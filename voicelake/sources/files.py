"""Files that Spark has no sink for: written by tasks, put in place by one commit."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


@dataclass
class Written(WriterCommitMessage):
    place: str
    folder: str


def write_files(df: DataFrame, path: str, write: Callable[[Iterator[pa.RecordBatch], Callable[[str], pa.NativeFile]], None]) -> None:
    """Calls ``write(batches, create)`` in every task; ``create(name)`` opens a file for it to fill and close.

    A task writes into a folder of its own below a temporary one. The commit moves the folders of the tasks that
    count to ``path``/part-N, so what failed, lost or repeated tasks left is never seen. A folder that holds
    files already is refused.
    """
    system, root = located(path)
    if any(x.base_name[0] not in "_." for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True))):
        raise FileExistsError(path)
    job = uuid.uuid4().hex
    temporary = f"{root}/_temporary-{job}"

    class Writer(DataSourceArrowWriter):
        def write(self, batches):
            system, own = located(path)[0], f"part-{TaskContext.get().partitionId():05d}"
            place, made = f"{temporary}/{own}-{uuid.uuid4().hex}", []

            def create(name):
                if not made:
                    system.create_dir(place)
                made.append(name)
                return system.open_output_stream(f"{place}/{name}", compression=None)

            write(batches, create)
            return Written(place if made else "", own)

        def commit(self, messages):
            system.create_dir(root)
            for message in messages:
                if message and message.place:
                    system.move(message.place, f"{root}/{message.folder}")
            self.abort(messages)
            system.open_output_stream(f"{root}/_SUCCESS").close()

        def abort(self, messages):
            if system.get_file_info(temporary).type == fs.FileType.Directory:
                system.delete_dir(temporary)

    class Files(DataSource):
        @classmethod
        def name(cls):
            return f"files_{job}"

        def writer(self, schema, overwrite):
            return Writer()

    df.sparkSession.dataSource.register(Files)
    df.write.format(Files.name()).mode("append").save()
