"""Image and label files as tables; paths are columns and bytes are read only when asked for."""

from __future__ import annotations

import contextlib
import hashlib
import io
import zipfile
import zlib
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import base_name, extension, stem
from .storage import LISTING, listed, system_of

#: Files that a task holds at once, and bytes of them and of members of archives beyond which it passes them on.
READ_AT_ONCE, READ_BYTES = 64, 16 << 20
#: Bytes of a file that are read at a time for its digest, and rows of archives' directories and members in a batch.
PART_BYTES, MEMBERS_AT_ONCE = 4 << 20, 1000
#: Extensions of images in order of preference, and split names by the folder names that stand for them.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".webp")
SPLIT_ALIASES = {"train": "train", "valid": "valid", "val": "valid", "validation": "valid", "test": "test"}


def listing(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """``path, length, modified`` of the files below ``root``, listed by executors; contents aren't read."""
    return listed(spark, root, recursive)


def is_image(path: Column) -> Column:
    return extension(path).isin(*IMAGE_EXTENSIONS)


def images(spark: SparkSession, root: str, recursive: bool = True, missing_ok: bool = True) -> DataFrame:
    """The image files below ``root``, by extension in any case. A missing root is empty."""
    if missing_ok and not exists(spark, root):
        return spark.createDataFrame([], LISTING)
    return listing(spark, root, recursive).filter(is_image(F.col("path")))


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def label_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """The ``.txt`` files in a ``labels`` folder below ``root``."""
    return listing(spark, root, recursive).filter(extension(F.col("path")).eqNullSafe(".txt") & has_folder(F.col("path"), "labels"))


def label_lines(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """``path, line_no, line`` of the ``.txt`` files in a ``labels`` folder; see ``file_lines``."""
    return file_lines(label_files(spark, root, recursive).select("path"))


def file_lines(found: DataFrame) -> DataFrame:
    """``found`` with the ``line_no, line`` of the small text file that each ``path`` names; an empty file has one
    row with a null line. A file that can't be read has one with a null line and ``readable`` false."""
    texts = contents(found).withColumn("value", F.col("content").cast("string"))
    return texts.select(*found.columns, F.posexplode_outer(lines_of(F.col("value"))).alias("line_no", "line"), F.col("content").isNotNull().alias("readable"))


def contents(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with the ``content`` of the small file that each row names, null where it can't be read.

    The names, not the contents, are dealt out first: a listing has few tasks and reading needs many.
    """

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data in read_files(batches, path):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], [*part.schema.names, "content"])

    dealt = files.repartition(files.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInArrow(opened, T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())]))


def read_files(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Rows with the bytes of the files that their column ``path`` names, None where one can't be read: up
    to ``READ_AT_ONCE`` files, or about ``READ_BYTES``, at once."""
    for batch in batches:
        begin, size, data = 0, 0, []
        for k, uri in enumerate(batch.column(path).to_pylist()):
            system, inside, _ = system_of(uri)
            try:
                with system.open_input_stream(inside) as f:
                    data.append(f.read())
            except OSError:
                data.append(None)
            size += len(data[-1] or b"")
            if len(data) == READ_AT_ONCE or size >= READ_BYTES or k + 1 == batch.num_rows:
                yield batch.slice(begin, len(data)), data
                begin, size, data = k + 1, 0, []


def digests(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with the ``sha256`` of the file that each row names, null where it can't be read.

    A file of any size passes through a few MB: a task reads it part by part, as the digest needs its bytes
    in their order.
    """

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for uri in batch.column(path).to_pylist():
                system, inside, _ = system_of(uri)
                seen = hashlib.sha256()
                try:
                    with system.open_input_stream(inside) as f:
                        while part := f.read(PART_BYTES):
                            seen.update(part)
                    out.append(seen.hexdigest())
                except OSError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "sha256"])

    dealt = files.repartition(files.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInArrow(digested, T.StructType([*files.schema.fields, T.StructField("sha256", T.StringType())]))


def lines_of(text: Column) -> Column:
    """The lines of a text without space around them, less the blank ones."""
    return F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")


def has_folder(path: Column, folder: str) -> Column:
    return F.array_contains(F.split(F.lower(path), "/"), folder)


def split_of(path: Column) -> Column:
    """The split that the first telling folder of a path names, else ``unknown``."""
    aliases = F.create_map(*[F.lit(x) for k, v in SPLIT_ALIASES.items() for x in (k, v)])
    parts = F.transform(F.split(F.lower(path), "/"), lambda p: F.try_element_at(aliases, p))
    return F.coalesce(F.get(F.filter(parts, lambda p: p.isNotNull()), 0), F.lit("unknown"))


def label_path(image: Column) -> Column:
    """The label file that belongs to an image: the ``labels`` folder beside ``images``."""
    moved = F.regexp_replace(image, r"/images/(?!.*/images/)", "/labels/")
    return F.regexp_replace(moved, r"\.[^./]*$", ".txt")


def best_of_stem(paths: DataFrame, folder: str = "folder", path: str = "path") -> DataFrame:
    """One image for each folder and stem: by order of extension, then by name."""
    rank = F.array_position(F.array(*map(F.lit, IMAGE_EXTENSIONS)), extension(F.col(path)))
    exact = F.when(F.regexp_extract(base_name(F.col(path)), r".(\.[^.]*)$", 1) == extension(F.col(path)), 0).otherwise(1)
    order = F.struct(exact.alias("c"), rank.alias("r"), F.col(path).alias("p"))
    return paths.groupBy(folder, stem(F.col(path)).alias("stem")).agg(F.min_by(path, order).alias(path))


def first_by_name(paths: DataFrame, path: str = "path") -> DataFrame:
    """``name, path``: the first path for each base name."""
    return paths.groupBy(base_name(F.col(path)).alias("name")).agg(F.min(path).alias(path))


def located(wanted: DataFrame, files: DataFrame, name: str = "file_name", path: str = "path") -> DataFrame:
    """``wanted`` with the path that ends in its name, or else the first with its base name."""
    direct = files.select(F.col(path).alias("direct"))
    tail = F.regexp_extract("direct", r"([^/]+/[^/]+)$", 1)
    exact = direct.withColumn("tail", tail).groupBy("tail").agg(F.min("direct").alias("direct"))
    by_name = first_by_name(files, path).select(F.col("name").alias("base"), F.col(path).alias("by_name"))
    keyed = wanted.withColumn("base", base_name(F.col(name)))
    joined = keyed.join(exact, F.col(name) == F.col("tail"), "left").join(by_name, "base", "left")
    return joined.select(*wanted.columns, F.coalesce("direct", "by_name").alias("path"))


class Ranged(io.RawIOBase):
    """A stored file as Python's libraries expect one: a place before its begin is an ``OSError``."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.at, self.end = file, 0, file.size()

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        to = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.end}[whence]
        if to < 0:
            raise OSError("a place before the file")
        self.at = to
        return to

    def tell(self) -> int:
        return self.at

    def readinto(self, buffer) -> int:
        data = self.file.read_at(max(0, min(len(buffer), self.end - self.at)), min(self.at, self.end))
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)


def archive_directory(spark: SparkSession, root: str) -> DataFrame:
    """``archive, member, header, packed, size, method, flags, crc`` of the members of the ZIP archives
    below ``root``, from the directory at each archive's end; no member is read."""

    names = ["archive", "member", "header", "packed", "size", "method", "flags", "crc"]

    def directory(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri in pdf["path"]:
                system, inside, _ = system_of(uri)
                with system.open_input_file(inside) as f, zipfile.ZipFile(io.BufferedReader(Ranged(f))) as z:
                    rows = ((uri, i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.flag_bits, i.CRC) for i in z.infolist() if not i.is_dir())
                    while part := list(islice(rows, MEMBERS_AT_ONCE)):
                        yield pd.DataFrame(part, columns=names)

    archives = listing(spark, root).filter(extension(F.col("path")) == ".zip").select("path")
    dealt = archives.repartition(spark.sparkContext.defaultParallelism)
    return dealt.mapInPandas(directory, "archive string, member string, header long, packed long, size long, method int, flags int, crc long")


def archive_members(spark: SparkSession, root: str) -> DataFrame:
    """``archive, member, content`` for each file in the ZIP archives below ``root``.

    Members are dealt out by the archives' directories, so that one archive is read by many tasks, each
    its own members by their ranges of bytes. A member that is encrypted, packed by another method than
    deflation, cut off or damaged has null content.
    """
    dealt = archive_directory(spark, root).repartition(spark.sparkContext.defaultParallelism).sortWithinPartitions("archive", "header")
    return dealt.mapInArrow(inflated, "archive string, member string, content binary")


def inflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members that rows of archives' directories name, many of them in a batch."""
    for batch in batches:
        with contextlib.ExitStack() as opened:
            at, f, begin, size, data = None, None, 0, 0, []
            for k, r in enumerate(batch.to_pylist()):
                if r["archive"] != at:
                    opened.close()
                    system, inside, _ = system_of(r["archive"])
                    at, f = r["archive"], opened.enter_context(system.open_input_file(inside))
                data.append(_member(f, r))
                size += len(data[-1] or b"")
                if len(data) == MEMBERS_AT_ONCE or size >= READ_BYTES or k + 1 == batch.num_rows:
                    part = batch.slice(begin, len(data))
                    yield pa.RecordBatch.from_arrays([part.column("archive"), part.column("member"), pa.array(data, pa.binary())], ["archive", "member", "content"])
                    begin, size, data = k + 1, 0, []


def _member(f: pa.NativeFile, r: dict) -> bytes | None:
    """The content of the member that a row of an archive's directory names."""
    head = f.read_at(30, r["header"])
    names = int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
    data = f.read_at(r["packed"], r["header"] + 30 + names)
    try:
        plain = data if r["method"] == zipfile.ZIP_STORED else zlib.decompress(data, -15) if r["method"] == zipfile.ZIP_DEFLATED else None
    except zlib.error:
        return None
    if plain is not None and (r["flags"] & 1 or len(plain) != r["size"] or zlib.crc32(plain) != r["crc"]):
        return None
    return plain


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text; bytes that aren't are replaced."""
    return F.pandas_udf(lambda s: s.map(lambda b: b.decode("utf-8", "replace"), na_action="ignore"), "string")(content)
