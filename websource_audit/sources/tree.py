"""A Spark data source for source trees: folders are its partitions, so files are listed and read by tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition, LessThan, LessThanOrEqual

#: Folders of version control and editors, whose files are never part of an application.
UNREAD = (".git", ".svn", ".hg", ".vs", ".vscode", ".idea")
#: Folders that the driver opens to find at least so many to share out.
FAN_OUT = 256
SCHEMA = "path string, rel_path string, length long, content binary"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Folder(InputPartition):
    """A folder to list: with all below it, or its own files alone, where its folders are partitions of their own."""

    path: str
    below: bool


def filesystem(root: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what stands before that path in an address)."""
    store, top = fs.FileSystem.from_uri(root if "://" in root else "file://" + root.removeprefix("file:"))
    top = top.rstrip("/")
    return store, top, root[: root.index(top)] if "://" in root and not root.startswith("file:") else "file:"


class TreeReader(DataSourceReader):
    """Lists folder by folder and gives one batch for each file. Options: path, unread, maxBytes, content."""

    def __init__(self, options: dict[str, str]) -> None:
        options = {k.lower(): v for k, v in options.items()}
        self.root = options["path"]
        self.unread = frozenset(options.get("unread", ",".join(UNREAD)).split(","))
        self.most = int(options["maxbytes"]) if options.get("maxbytes") else None
        self.content = options.get("content", "true").lower() == "true"

    def entries(self, store: fs.FileSystem, folder: str) -> Iterator[fs.FileInfo]:
        for x in store.get_file_info(fs.FileSelector(folder)):
            if x.type == fs.FileType.File or (x.type == fs.FileType.Directory and x.base_name not in self.unread):
                yield x

    def partitions(self) -> list[Folder]:
        """Opens folders level by level until there are enough of them; of what it sees, only folders are kept."""
        store, top, _ = filesystem(self.root)
        opened, level = [], [top]
        while level and len(level) < FAN_OUT:
            opened += level
            level = [x.path for folder in level for x in self.entries(store, folder) if x.type == fs.FileType.Directory]
        return [*(Folder(x, False) for x in opened), *(Folder(x, True) for x in level)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        store, top, head = filesystem(self.root)
        left = [partition.path]
        while left:
            for x in self.entries(store, left.pop()):
                if x.type == fs.FileType.Directory:
                    if partition.below:
                        left.append(x.path)
                elif self.most is None or x.size <= self.most:
                    data = None
                    if self.content:
                        with store.open_input_stream(x.path) as f:
                            data = f.read()
                    yield pa.RecordBatch.from_arrays([pa.array([head + x.path]), pa.array([x.path[len(top) + 1 :]]), pa.array([x.size], pa.int64()), pa.array([data], pa.binary())], ["path", "rel_path", "length", "content"])


class PushingReader(TreeReader):
    """A reader that takes upper bounds of ``length``: larger files are not opened."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, LessThanOrEqual | LessThan) and f.attribute == ("length",):
                bound = f.value if isinstance(f, LessThanOrEqual) else f.value - 1
                self.most = bound if self.most is None else min(self.most, bound)
            else:
                yield f


class SourceTree(DataSource):
    """``spark.read.format("source_tree").load(root)``: every file below a folder, names that start with a dot or underscore too."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return (PushingReader if self.options.get("pushdown") == "true" else TreeReader)(dict(self.options))


def load_tree(spark: SparkSession, root: str, unread: tuple[str, ...] = UNREAD, max_bytes: int | None = None, content: bool = True):
    """SCHEMA rows of a tree. Where the session has filter pushdown for Python sources, conditions on length are pushed as well."""
    spark.dataSource.register(SourceTree)
    reader = spark.read.format(SourceTree.name()).option("unread", ",".join(unread)).option("content", content).option("pushdown", str(spark.conf.get(PUSHDOWN, "false")).lower())
    return (reader.option("maxBytes", max_bytes) if max_bytes is not None else reader).load(root)
