"""File systems by URI, for tasks, and a table of the files below a folder that executors list."""

from __future__ import annotations

import os
import stat
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from zlib import crc32

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LISTING = "path string, length long, modified timestamp"
#: Folders that a listing is dealt out by, at least, where there are so many.
FOLDERS = 64
#: Entries of a folder that are looked at before it counts as wide, tasks that list a wide one, and files in a batch of a listing.
PEEK, SHARES, LISTED_AT_ONCE = 10_000, 8, 10_000


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system, as Spark's own readers write it; without a slash at its end."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share, ``spark.checkpoint.dir``; a temporary
    one only where that is unset and the master is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{tempfile.mkdtemp(prefix='siftwork-')}/{name}"


def stored(df: DataFrame, folder: str) -> DataFrame:
    """``df`` as a Parquet table, read again: its lineage ends there."""
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def discard(spark: SparkSession, *folders: str) -> None:
    """Deletes tables that nothing reads any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def system_of(uri: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a qualified path, the path in it, and what stands before that in the URI."""
    if uri.startswith("file:"):
        plain = "/" + uri[5:].lstrip("/")
        return fs.LocalFileSystem(), plain, "file:"
    if "://" not in uri:
        return fs.LocalFileSystem(), uri, ""
    system, inside = fs.FileSystem.from_uri(uri)
    return system, inside, uri[: uri.rfind(inside)] if inside and uri.endswith(inside) else uri.partition("://")[0] + "://"


@dataclass
class Folder(InputPartition):
    """Folders that a task lists; of a wide one it takes the names of its ``share``."""

    paths: list[str]
    recursive: bool
    share: int = 0
    shares: int = 1


def _entries(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, os.DirEntry | fs.FileInfo]]:
    """``name, is a folder, entry`` of what lies in a folder, less hidden names; one at a time where the file system is local."""
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for e in found:
                if not e.name.startswith(("_", ".")):
                    yield e.name, e.is_dir(), e
        return
    for info in system.get_file_info(fs.FileSelector(folder)):
        if not info.base_name.startswith(("_", ".")):
            yield info.base_name, info.type == fs.FileType.Directory, info


def _facts(entry: os.DirEntry | fs.FileInfo) -> tuple[int, int] | None:
    """Bytes and microseconds of the last change of a file; None if there is none (any more)."""
    if isinstance(entry, fs.FileInfo):
        return (entry.size, (entry.mtime_ns or 0) // 1000) if entry.type == fs.FileType.File else None
    try:
        found = entry.stat()
    except FileNotFoundError:
        return None
    return (found.st_size, found.st_mtime_ns // 1000) if stat.S_ISREG(found.st_mode) else None


class FolderReader(DataSourceReader):
    """Folders are found first, level by level, until there are enough to deal out; a task then lists the
    files of its folders, and of all below where the last level isn't its own. A folder that is wide, with more
    than ``PEEK`` entries or more folders than are wanted, isn't read to its end for that: several tasks list it,
    each by a share of its names. So neither tasks nor what the driver holds grow with the tree."""

    def __init__(self, options):
        self.root = options["path"]
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.folders = int(options.get("folders", FOLDERS))

    def _below(self, system: fs.FileSystem, folder: str) -> list[str] | None:
        """The folders in ``folder``, or None if it is wide."""
        local, found = isinstance(system, fs.LocalFileSystem), []
        for k, (name, is_folder, _) in enumerate(_entries(system, folder)):
            if local and (k >= PEEK or len(found) > max(self.folders, SHARES)):
                return None
            if is_folder:
                found.append(f"{folder.rstrip('/')}/{name}")
        return found

    def partitions(self) -> list[Folder]:
        system, root, _ = system_of(self.root)
        level, own, out = [root], [], []
        while level and len(level) + len(own) < (self.folders if self.recursive else 2):
            below = []
            for f in level:
                if (found := self._below(system, f)) is None:
                    out += [Folder([f], self.recursive, k, SHARES) for k in range(SHARES)]
                else:
                    own.append(f)
                    below += found
            level = below if self.recursive else []
        # other file systems have no limit to what is found in a folder
        most = 4 * self.folders
        return out + [Folder(part, deep) for every, deep in ((own, False), (level, True)) for k in range(most) if (part := every[k::most])]

    def _files(self, partition: Folder) -> Iterator[tuple[str, int, int]]:
        system, _, prefix = system_of(self.root)
        folders = [(f, partition.shares) for f in partition.paths]
        while folders:
            folder, shares = folders.pop()
            for name, is_folder, entry in _entries(system, folder):
                if shares > 1 and crc32(os.fsencode(name)) % shares != partition.share:
                    continue
                path = f"{folder.rstrip('/')}/{name}"
                if not is_folder and (facts := _facts(entry)) is not None:
                    yield (prefix + path, *facts)
                elif is_folder and partition.recursive:
                    folders.append((path, 1))

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        files = self._files(partition)
        while rows := list(islice(files, LISTED_AT_ONCE)):
            columns = zip(zip(*rows), (pa.string(), pa.int64(), pa.timestamp("us", "UTC")))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in columns], ["path", "length", "modified"])


class FolderSource(DataSource):
    """``path, length, modified`` of files, empty ones too; no content is read."""

    @classmethod
    def name(cls) -> str:
        return "siftwork_folder"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def listed(spark: SparkSession, root: str, recursive: bool = True, folders: int = FOLDERS) -> DataFrame:
    """The files below ``root`` as ``LISTING``. Names that begin with a point or an underscore are left out."""
    spark.dataSource.register(FolderSource)
    reader = spark.read.format(FolderSource.name()).option("recursive", str(recursive).lower()).option("folders", str(folders))
    return reader.load(qualified(spark, root))
