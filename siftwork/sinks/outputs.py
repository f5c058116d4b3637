"""Datasets as Parquet by split, CSV manifests, JSON and Markdown reports."""

from __future__ import annotations

import contextlib
import json
import os
import time
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.labels import fixed8
from ..sources.files import PART_BYTES
from ..sources.storage import qualified, system_of

#: The columns of a manifest, in order.
MANIFEST = ["source", "source_split", "family_id", "is_negative", "source_image", "output_name", "final_split", "sha256", "dhash", "width", "height"]
POLICIES = {"replace": "overwrite", "refuse": "errorifexists"}


def write_split(records: DataFrame, path: str, split: str = "final_split", policy: str = "replace") -> None:
    records.write.mode(POLICIES[policy]).partitionBy(split).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


@dataclass
class Written(WriterCommitMessage):
    """What a task found while it wrote: codes of violations with their numbers."""

    violations: dict[str, int]


def _parts(content: bytes | None, source: str | None) -> Iterator[bytes]:
    """A file's bytes: those of the file that ``source`` names, part by part, or else ``content``."""
    if source is None:
        yield content or b""
        return
    try:
        system, inside, _ = system_of(source)
        with system.open_input_stream(inside) as f:
            while part := f.read(PART_BYTES):
                yield part
    except OSError as lost:
        raise ValueError(f"cannot read {source}") from lost


class TreeWriter(DataSourceArrowWriter):
    """Writes one file a row below a staging folder; the tree changes places with it when all tasks are done.

    A local file is made under its name if nothing has that name; else, and on other file systems, it is written
    under a name of its attempt and renamed. So no attempt writes into a file of another, one that follows a part
    of a file puts the whole in its place, and attempts of a task write equal bytes. Violations that rows carry
    are counted on the way; if there is one, the tree isn't changed.
    """

    def __init__(self, root: str, staging: str):
        self.root, self.staging = root, staging

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, base, _ = system_of(self.staging)
        made: set[str] = set()
        wrong: Counter[str] = Counter()
        for batch in iterator:
            for name, content, codes, source in zip(*(c.to_pylist() for c in batch.columns)):
                wrong.update(codes or ())
                path = f"{base}/{name}"
                folder = path.rpartition("/")[0]
                if folder not in made:
                    self._make(system, base, folder)
                    made.add(folder)
                self._file(system, path, _parts(content, source))
        return Written(dict(wrong))

    @staticmethod
    def _file(system: fs.FileSystem, path: str, parts: Iterator[bytes]) -> None:
        if isinstance(system, fs.LocalFileSystem):
            # renaming would double what is done to a folder, which tasks that write into it wait for
            with contextlib.suppress(FileExistsError), open(path, "xb") as f:
                f.writelines(parts)
                return
        partial = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        with system.open_output_stream(partial) as f:
            for part in parts:
                f.write(part)
        system.move(partial, path)

    @staticmethod
    def _make(system: fs.FileSystem, base: str, folder: str) -> None:
        """Folders below ``base``, which the driver made: a task that outlives a failed job can't bring it back."""
        at = base
        for part in folder[len(base) :].split("/"):
            if part:
                at = f"{at}/{part}"
                system.create_dir(at, recursive=False)

    def commit(self, messages: list) -> None:
        wrong: Counter[str] = Counter()
        for m in messages:
            wrong.update(m.violations)
        if wrong:
            raise ValueError("violations: " + ", ".join(f"{code}={wrong[code]}" for code in sorted(wrong)))
        system, root, _ = system_of(self.root)
        new, old = system_of(self.staging)[1], f"{root}.old-{uuid.uuid4().hex}"
        if system.get_file_info(root).type != fs.FileType.NotFound:
            system.move(root, old)
        else:
            system.create_dir(root.rpartition("/")[0], recursive=True)
        system.move(new, root)
        if system.get_file_info(old).type != fs.FileType.NotFound:
            system.delete_dir(old)

    def abort(self, messages: list) -> None:
        """``write_tree`` deletes what was staged, when no task of the job can add to it any more."""


class TreeSink(DataSource):
    """Rows ``name, content, violations, source`` as a tree of files that replaces the one before as a whole or not at all."""

    @classmethod
    def name(cls) -> str:
        return "siftwork_tree"

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["path"], self.options["staging"])


def write_tree(rows: DataFrame, root: str, name: str, content: str, policy: str = "replace", violations: str | None = None, source: str | None = None) -> None:
    """One file below ``root`` for each row, in a folder that all executors share.

    What was there stays until every file is written; then the new tree takes its place. If a task
    fails for good, the old tree is left as it was. ``refuse`` raises if there is one. ``violations`` is
    a column with an array of codes: they are counted in the pass that writes, and any of them fails it
    as a whole, with their numbers in the error. ``source`` is a column with the path of a file that is
    copied instead of ``content``, where it isn't null; one that can't be read fails the whole too. The file
    system must be able to rename folders.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {tuple(POLICIES)}")
    spark = rows.sparkSession
    spark.dataSource.register(TreeSink)
    where = qualified(spark, root)
    path, system = _hadoop(spark, where)
    if policy == "refuse" and system.exists(path):
        raise ValueError(f"{root} exists")
    codes = F.lit(None).cast("array<string>") if violations is None else F.col(violations)
    copied = F.lit(None).cast("string") if source is None else F.col(source)
    pairs = rows.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content"), codes.alias("violations"), copied.alias("source"))
    staged, system = _hadoop(spark, f"{where}.new-{uuid.uuid4().hex}")
    system.mkdirs(staged)
    try:
        pairs.write.format(TreeSink.name()).mode("append").option("staging", staged.toString()).save(where)
    finally:
        # tasks of a failed job may still be writing
        for _ in range(100):
            if not system.exists(staged):
                break
            with contextlib.suppress(Exception):
                system.delete(staged, True)
            time.sleep(0.1)


def write_files(rows: DataFrame, root: str, name: str, content: str) -> None:
    """The tree of ``write_tree`` at a place that may hold one already."""
    write_tree(rows, root, name, content)


def write_dataset(records: DataFrame, root: str, split: str = "final_split", policy: str = "replace", violations: str | None = None) -> None:
    """Images and label files of ``records`` by split, images copied from ``image_path``, in one commit.

    ``labels`` are the lines of a record's label file and ``output_name`` is its image's name. An image
    that can't be read fails the whole, and the tree before it stays; so do ``violations`` of a record.
    ``records`` is gone through once: a record's two files are written by the task that has it.
    """
    base = F.regexp_replace("output_name", r"\.[^./]*$", "")
    text = F.when(F.size("labels") > 0, F.concat(F.array_join("labels", "\n"), F.lit("\n"))).otherwise("")
    codes = F.lit(None).cast("array<string>") if violations is None else F.col(violations)
    image = F.coalesce("image_path", F.raise_error(F.lit("cannot read an image without path")).cast("string"))
    file = lambda name, content, codes, source: F.struct(name.alias("name"), content.cast("binary").alias("content"), codes.cast("array<string>").alias("violations"), source.cast("string").alias("source"))
    label = file(F.concat_ws("/", split, F.lit("labels"), F.concat(base, F.lit(".txt"))), text, codes, F.lit(None))
    copy = file(F.concat_ws("/", split, F.lit("images"), "output_name"), F.lit(None), F.lit(None), image)
    # files take time by their number, not by their rows' bytes
    dealt = records.repartition(records.sparkSession.sparkContext.defaultParallelism)
    rows = dealt.select(F.explode(F.array(label, copy)).alias("file")).select("file.*")
    write_tree(rows, root, "name", "content", policy, "violations", "source")


def write_joined(rows: DataFrame, path: str, order: list[str], text: str, head: str = "", tail: str = "", bom: bool = False) -> int:
    """One file with ``text`` of all rows in ``order``, between ``head`` and ``tail``; returns its bytes.

    Rows are dealt by ranges of ``order``, each task sorts and encodes its own and writes a part, and the
    parts are joined by the file system, or streamed one after another where it can't; no task and no
    Python process holds the whole. Equal rows give equal bytes, whatever the number of tasks.
    """
    spark = rows.sparkSession
    where = qualified(spark, path)
    staging = f"{where}.parts-{uuid.uuid4().hex}"

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base, _ = system_of(staging)
        system.create_dir(base, recursive=True)
        name, number, size = f"{base}/{uuid.uuid4().hex}", TaskContext.get().partitionId(), 0
        with system.open_output_stream(name) as f:
            for pdf in batches:
                data = "".join(pdf["text"].fillna("")).encode("utf-8")
                size += len(data)
                f.write(data)
        yield pd.DataFrame({"part": [number], "name": [name.rpartition("/")[2]], "size": [size]})

    keys = rows.select(F.col(text).alias("text"), *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)])
    by = [*[F.col(f"o{i}").asc_nulls_first() for i in range(len(order))], F.col("text")]
    dealt = keys.repartitionByRange(*by).sortWithinPartitions(*by).select("text")
    target, system = _hadoop(spark, f"{staging}/joined")
    try:
        # a row for each task
        parts = sorted(dealt.mapInPandas(encoded, "part int, name string, size long").filter("size > 0").collect())
        system.mkdirs(target.getParent())
        begin, end = (b"\xef\xbb\xbf" if bom else b"") + head.encode("utf-8"), tail.encode("utf-8")
        ending, _ = _hadoop(spark, f"{staging}/tail")
        for where_to, data in ((target, begin), (ending, end)):
            out = system.create(where_to, True)
            out.write(data)
            out.close()
        _join(spark, system, target, [_hadoop(spark, f"{staging}/{p['name']}")[0] for p in parts] + ([ending] if tail else []))
        final, _ = _hadoop(spark, where)
        system.mkdirs(final.getParent())
        if system.exists(final):
            system.delete(final, False)
        system.rename(target, final)
    finally:
        system.delete(target.getParent(), True)
    return len(begin) + sum(p["size"] for p in parts) + len(end)


def _join(spark: SparkSession, system, target, names: list) -> None:
    """Appends files to ``target``: by the file system's own means where it has them, else as a stream."""
    if not names:
        return
    listed = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Path, len(names))
    for i, n in enumerate(names):
        listed[i] = n
    try:
        system.concat(target, listed)
        return
    except UnsupportedOperationException:
        pass
    whole = spark._jvm.org.apache.hadoop.fs.Path(target.toString() + "-whole")
    out = system.create(whole, True)
    for n in [target, *names]:
        part = system.open(n)
        spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
        part.close()
    out.close()
    system.delete(target, False)
    system.rename(whole, target)


def manifest(records: DataFrame, base_names: bool = True, booleans: tuple[str, str] = ("true", "false")) -> DataFrame:
    """The manifest's columns, in order, as text where formats differ."""
    image = F.element_at(F.split("source_image", "/"), -1) if base_names else F.col("source_image")
    flag = F.when(F.col("is_negative"), booleans[0]).otherwise(booleans[1])
    return records.withColumn("source_image", image).withColumn("is_negative", flag).select(*MANIFEST)


#: How a manifest is written: line breaks, a byte order mark, whole paths of images, and words for flags.
VARIANTS = {
    "plain": {"line_break": "\n", "bom": False, "base_names": True, "booleans": ("true", "false")},
    "windows": {"line_break": "\r\n", "bom": False, "base_names": False, "booleans": ("True", "False")},
    "marked": {"line_break": "\r\n", "bom": True, "base_names": False, "booleans": ("True", "False")},
}


def csv_line(columns: list[str], line_break: str) -> Column:
    """A row as a line of CSV: fields with a comma, a quote or a line break in quotes, null as nothing."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    field = lambda c: F.when(text(c).rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text(c))
    return F.concat(F.concat_ws(",", *[field(c) for c in columns]), F.lit(line_break))


def write_manifest(records: DataFrame, path: str, variant: str = "plain") -> int:
    """One CSV file of the manifest's columns in the order of the output names; returns its bytes."""
    form = VARIANTS[variant]
    rows = manifest(records, form["base_names"], form["booleans"]).withColumn("_line", csv_line(MANIFEST, form["line_break"]))
    return write_joined(rows, path, ["output_name"], "_line", ",".join(MANIFEST) + form["line_break"], bom=form["bom"])


def label_text(labels: DataFrame, record: list[str], order: str) -> DataFrame:
    """The label file of each record, numbers with eight decimals. A record's labels are few."""
    line = F.concat_ws(" ", F.col("class_id").cast("string"), *[fixed8(F.col(c)) for c in "xywh"])
    each = labels.select(*record, order, line.alias("line"))
    return each.groupBy(*record).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "\n").alias("text"))


def report(**parts: DataFrame) -> dict:
    """Small aggregates as a mapping of lists of rows."""
    return {name: [r.asDict(recursive=True) for r in df.collect()] for name, df in parts.items()}


def write_json(data: dict, path: str) -> str:
    """Keys sorted, no time and no absolute path, so equal data give equal bytes."""
    return write_text(json.dumps(data, sort_keys=True, indent=2, ensure_ascii=False) + "\n", path)


def write_text(text: str, path: str) -> str:
    """A small text, such as a report, as one file."""
    where = path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"
    system, name = fs.FileSystem.from_uri(where)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    with system.open_output_stream(name) as f:
        f.write(text.encode("utf-8"))
    return text


def with_root(description: str, root: str) -> str:
    """A dataset description whose ``path:`` line names ``root``; it gets one if it has none."""
    kept = [line for line in description.splitlines() if not line.startswith("path:")]
    return "\n".join([f"path: {root}", *kept]) + "\n"


def comparison_csv(rows: DataFrame, key: str, path: str) -> None:
    rows.orderBy(key).coalesce(1).write.mode("overwrite").csv(path, header=True)


def dataset_description(root: str, classes: list[str]) -> str:
    lines = [f"path: {root}", "train: images/train", "val: images/valid", "names:"]
    return "\n".join([*lines, *[f"  {i}: {c}" for i, c in enumerate(classes)]]) + "\n"


def comparison_markdown(rows: DataFrame, key: str) -> str:
    """A table of ``before, after, change`` with four decimals, N/A where a side is missing."""
    show = lambda v, form: "N/A" if v is None else format(v, form)
    out = [f"| {key} | before | after | change |", "|---|---|---|---|"]
    for r in rows.orderBy(key).collect():
        out.append(f"| {r[key]} | {show(r['before'], '.4f')} | {show(r['after'], '.4f')} | {show(r['change'], '+.4f')} |")
    return "\n".join(out) + "\n"
