"""Files under a root as a partitioned data source, hidden names included and links resolved.

Spark's file listing skips names that start with ``_`` or ``.`` and lists on the driver. This
``DataSource`` walks the upper folders once, until there are enough of them, and makes each remaining folder a
partition that a task lists by itself. A symbolic link to a file is listed as
the file it leads to; links to folders are not followed. A folder that can't be
read has no files.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from neardup.session import ship_by_value

ship_by_value(__name__)

#: Folders to find before the rest is left to the tasks.
FOLDERS = 64


def filesystem(path: str):
    """(pyarrow file system, path in it) of a Spark path such as ``file:/a``, ``s3a://b/c`` or ``/a``."""
    from pyarrow import fs
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if colon and scheme == "file" else path).lstrip("/")
    authority, _, inner = rest.lstrip("/").partition("/")
    found, base = fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme) }://{authority}/")
    return found, f"{base.rstrip('/')}/{inner}"


def _is_local(root: str) -> bool:
    scheme, colon, _ = root.partition(":")
    return not colon or "/" in scheme or scheme == "file"


def entries(root: str, folder: str) -> tuple[list[str], list[tuple[str, str, int, int]]]:
    """(folders, files) of one folder; a file is (name, resolved path, modification time in ms, size)."""
    if _is_local(root):
        folders, files = [], []
        try:
            with os.scandir(folder) as found:
                listed = list(found)
        except OSError:
            return [], []
        for e in listed:
            try:
                if e.is_dir(follow_symlinks=False):
                    folders.append(e.path)
                elif e.is_file():
                    info = e.stat()
                    files.append((e.name, "file:" + os.path.realpath(e.path), info.st_mtime_ns // 1_000_000, info.st_size))
            except OSError:         # gone meanwhile, or a link to nothing
                continue
        return folders, files
    from pyarrow import fs
    system, _ = filesystem(root)
    prefix = root[:root.index("://") + 3]
    try:
        listed = system.get_file_info(fs.FileSelector(folder))
    except OSError:
        return [], []
    folders = [i.path for i in listed if i.type == fs.FileType.Directory]
    files = [(i.base_name, prefix + i.path.lstrip("/") if prefix[:2] == "s3" else _with_authority(root, i.path),
              (i.mtime_ns or 0) // 1_000_000, i.size) for i in listed if i.type == fs.FileType.File]
    return folders, files


def _with_authority(root: str, path: str) -> str:
    scheme, _, rest = root.partition("://")
    return f"{scheme}://{rest.partition('/')[0]}/{path.lstrip('/')}"


def _suffix(name: str) -> str:
    return os.path.splitext(name)[1].lower()


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        super().__init__((path, deep))
        self.path, self.deep = path, deep


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.recursive = options.get("recursive", "true") == "true"
        self.suffixes = frozenset(options["suffixes"].split(",")) if options.get("suffixes") else None

    def partitions(self) -> list[InputPartition]:
        top = os.path.realpath(filesystem(self.root)[1]) if _is_local(self.root) else filesystem(self.root)[1]
        if not self.recursive:
            return [Folder(top, False)]
        listed, ahead = [], [top]
        while ahead and len(ahead) < FOLDERS:
            here = ahead.pop(0)
            listed.append(Folder(here, False))
            ahead += entries(self.root, here)[0]
        return listed + [Folder(f, True) for f in ahead]

    def read(self, partition: Folder) -> Iterator[tuple]:
        ahead = [partition.path]
        while ahead:
            folders, files = entries(self.root, ahead.pop())
            if partition.deep:
                ahead += folders
            for name, path, mtime, size in files:
                if self.suffixes is None or _suffix(name) in self.suffixes:
                    yield path, mtime, size


class FolderSource(DataSource):
    """``spark.read.format("folders").load(root)`` with options ``recursive`` and ``suffixes`` (comma-separated)."""

    @classmethod
    def name(cls) -> str:
        return "folders"

    def schema(self) -> str:
        return "path string, mtime_ms long, file_size long"

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options)


def discover(spark: SparkSession, root: str, suffixes: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """(path, mtime, file_size) of the files under ``root``, each resolved path once."""
    spark.dataSource.register(FolderSource)
    reader = spark.read.format("folders").option("recursive", str(recursive).lower())
    if suffixes is not None:
        reader = reader.option("suffixes", ",".join(suffixes))
    found = reader.load(root).dropDuplicates(["path"])
    return found.select("path", F.timestamp_millis("mtime_ms").alias("mtime"), "file_size")
