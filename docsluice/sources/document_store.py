"""A document store as a Spark data source: one JSON object a document, below a root that driver and executors share.

    register(spark)
    rows.write.format("document_store").mode("append").save(root)              # put
    spark.read.format("document_store").schema(schema).load(root)              # get, filters on object_key reach the listing
    keys.write.format("document_store").mode("append").option("action", "delete").save(root)

Rows have object_key and any other columns; a put without a key gets a new one. Tasks write into a
folder of their own run; the driver moves what successful tasks report, so a failed task or job leaves
nothing behind. Deleting is done again without harm. A key is one name: it can't leave the root.

The root is any address that pyarrow knows (a local or shared folder, s3://, hdfs://).
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

from pyarrow import fs
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType, _parse_datatype_string

KEY = "object_key"
STAGE = ".staging"
#: Objects that one task reads.
READ_TOGETHER = 500


class InvalidKey(ValueError):
    """An object key that is no plain name."""


def object_name(key: str) -> str:
    """The key, if it names an object right below the root: no separators, no hidden names, nothing that leads elsewhere."""
    if not isinstance(key, str) or not re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9_.=-]{0,199}", key) or ".." in key:
        raise InvalidKey(f"invalid document object key: {key!r}")
    return key


def opened(root: str) -> tuple[fs.FileSystem, str]:
    files, path = fs.FileSystem.from_uri(root) if re.match(r"[a-z0-9]+:", root) else (fs.LocalFileSystem(), root)
    return files, path.rstrip("/")


def held(files: fs.FileSystem, root: str, key: str) -> str | None:
    """Where the object lies, null if there is none; a link that leads out of the root counts as none."""
    path = f"{root}/{object_name(key)}"
    info = files.get_file_info(path)
    if info.type != fs.FileType.File:
        return None
    if isinstance(files, fs.LocalFileSystem):
        from pathlib import Path

        if Path(root).resolve() != Path(path).resolve().parent:
            raise InvalidKey(f"invalid document object key: {key!r}")
    return path


@dataclass
class Keys(InputPartition):
    names: list[str]


class Reader(DataSourceReader):
    def __init__(self, root: str, schema: StructType):
        self.root, self.schema, self.asked = root, schema, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keys that are asked for by name are looked up; nothing is listed for them."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == (KEY,):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.asked = some if self.asked is None else self.asked & some
            else:
                yield f

    def partitions(self) -> list[Keys]:
        files, root = opened(self.root)
        if self.asked is None:
            listed = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
            names = sorted(i.base_name for i in listed if i.type == fs.FileType.File and not i.base_name.startswith("."))
        else:
            names = sorted(self.asked)
        return [Keys(names[i : i + READ_TOGETHER]) for i in range(0, max(len(names), 1), READ_TOGETHER)]

    def read(self, partition: Keys) -> Iterator[tuple]:
        files, root = opened(self.root)
        columns = self.schema.names
        for name in partition.names:
            if path := held(files, root, name):
                with files.open_input_stream(path) as f:
                    document = json.loads(f.read()) | {KEY: name}
                yield tuple(document.get(c) for c in columns)


@dataclass
class Put(WriterCommitMessage):
    folder: str
    names: list[str]


class Writer(DataSourceWriter):
    """Puts rows: staged by tasks, moved to their names when all tasks have ended well."""

    def __init__(self, root: str):
        self.root, self.run = root, uuid4().hex

    def begun(self) -> Writer:
        """With the run's folder, which the driver makes: a task that outlives its job finds none and ends."""
        files, root = opened(self.root)
        files.create_dir(f"{root}/{STAGE}/{self.run}", recursive=True)
        return self

    def write(self, rows: Iterator[Row]) -> Put:
        files, root = opened(self.root)
        folder = f"{root}/{STAGE}/{self.run}/{uuid4().hex}"
        files.create_dir(folder, recursive=False)
        names = []
        for row in rows:
            document = row.asDict(recursive=True)
            name = object_name(document.pop(KEY, None) or f"{uuid4()}.json")
            with files.open_output_stream(f"{folder}/{name}") as f:
                f.write(json.dumps(document, ensure_ascii=False, sort_keys=True, default=str).encode())
            names.append(name)
        return Put(folder, names)

    def commit(self, messages: list[Put | None]) -> None:
        files, root = opened(self.root)
        for m in filter(None, messages):
            for name in dict.fromkeys(m.names):
                files.move(f"{m.folder}/{name}", f"{root}/{name}")
        self._cleared(files, root)

    def abort(self, messages: list[Put | None]) -> None:
        files, root = opened(self.root)
        self._cleared(files, root)

    def _cleared(self, files: fs.FileSystem, root: str) -> None:
        run, stage = f"{root}/{STAGE}/{self.run}", f"{root}/{STAGE}"
        for _ in range(20):  # a task that is being stopped may add a file meanwhile
            try:
                if files.get_file_info(run).type == fs.FileType.Directory:
                    files.delete_dir(run)
                break
            except OSError:
                time.sleep(0.1)
        try:
            if not files.get_file_info(fs.FileSelector(stage)):
                files.delete_dir(stage)
        except OSError:
            pass  # another run's folder came, or the last one went


class Eraser(DataSourceWriter):
    """Deletes the objects that rows name; a missing one is no fault."""

    def __init__(self, root: str):
        self.root = root

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        files, root = opened(self.root)
        for name in [object_name(row[KEY]) for row in rows]:  # all are looked at before the first goes
            if path := held(files, root, name):
                files.delete_file(path)
        return WriterCommitMessage()


class DocumentStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_store"

    def schema(self) -> StructType:
        return _parse_datatype_string(f"{KEY} string, title string, text string")

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a document store is appended to; delete what should go")
        return Eraser(self.options["path"]) if self.options.get("action") == "delete" else Writer(self.options["path"]).begun()


def register(spark: SparkSession) -> None:
    """Makes the source known to the session, and lets filters on keys reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentStore)
