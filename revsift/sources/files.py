"""A sink that stores each row as a file of its own, under a name the row gives.

Spark's own writers choose the names of their files; folders of documents
(``*.md``, ``*.pdf``) need others. ``NamedFiles`` is a Python data source:
tasks write rows to the target through the file system that its URI names
(local or shared folders, HDFS, object stores, by ``pyarrow.fs``), each file
under a temporary name first and then renamed, so that a reader never sees half
a file and a task that runs again replaces its own files. A marker is written
when all tasks have ended.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MARKER = "_SUCCESS"


def _target(path: str):
    from pyarrow import fs

    # file:/a, file:///a and /a are one folder
    return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


@dataclass
class Written(WriterCommitMessage):
    files: int


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, base = _target(self.path)
        system.create_dir(base, recursive=True)
        count = 0
        for row in rows:
            name, content = row["name"], row["content"]
            if not name or "/" in name or name.startswith(("_", ".")):
                raise ValueError(f"not the name of a visible file: {name!r}")
            part = f"{base}/_{uuid.uuid4().hex}"
            with system.open_output_stream(part) as out:
                out.write(bytes(content or b""))
            system.move(part, f"{base}/{name}")
            count += 1
        return Written(count)

    def commit(self, messages: list) -> None:
        system, base = _target(self.path)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/{MARKER}") as out:
            out.write(b"")

    def abort(self, messages: list) -> None:
        """Files of tasks that ended stay; without the marker the folder is not whole."""


class NamedFiles(DataSource):
    """``df(name string, content binary)`` to files; option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return NamedFilesWriter(self.options["path"])


def write_named_files(files: DataFrame, path: str) -> None:
    """One file for each row of ``files(name, content)``; names are unique, a name that comes again replaces its file."""
    files.sparkSession.dataSource.register(NamedFiles)
    files.select("name", "content").write.format("named_files").mode("append").option("path", path).save()
