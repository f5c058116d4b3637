"""Training runs: result tables and run folders."""

from __future__ import annotations

import csv
import io
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import first_present, number
from .files import exists, read_files
from .storage import LISTING, listed

#: Rows of result tables that a task passes on at once, at least.
ROWS_AT_ONCE = 2000
MARKS = ("results.csv", "weights/best.pt", "weights/last.pt")


def results(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table with all columns as text, names and values trimmed, a byte order mark dropped.

    A file that isn't there, or is empty, is an empty table and a warning.
    """
    if not exists(spark, path):
        warnings.warn(f"cannot read {path}", stacklevel=2)
        return spark.createDataFrame([], "none string").drop("none")
    if spark.read.text(path).isEmpty():
        warnings.warn(f"{path} is empty", stacklevel=2)
        return spark.createDataFrame([], "none string").drop("none")
    df = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE")
    return df.toDF(*[c.strip().lstrip("﻿") for c in df.columns])


def metric(df: DataFrame, aliases: list[str]):
    """The finite numbers of the first column that is there; null without one."""
    found = first_present(df.columns, aliases)
    return number(F.trim(F.col(f"`{found}`"))) if found else F.lit(None).cast("double")


def run_rows(tables: DataFrame, run: str = "run", path: str = "path") -> DataFrame:
    """``run, row_no, values`` of many result tables: a row's values by its own file's header, names and
    values trimmed, a byte order mark dropped, blank lines left out, missing values null.

    Each file is read by one task, line by line; a file that can't be read, or whose text isn't UTF-8,
    has no row.
    """

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        batch = lambda names, numbers, values: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int32()), pa.array(values, kind)], ["run", "row_no", "values"])
        held: tuple[list, list, list] = ([], [], [])
        for part, data in read_files(batches, "path"):
            for name, content in zip(part.column("run").to_pylist(), data):
                try:
                    rows = list(csv.DictReader(io.StringIO((content or b"").decode("utf-8-sig"), newline="")))
                except (UnicodeError, csv.Error):
                    continue
                held[0].extend([name] * len(rows))
                held[1].extend(range(len(rows)))
                held[2].extend(list({str(k).strip(): v.strip() if isinstance(v, str) else None for k, v in r.items() if k is not None}.items()) for r in rows)
                # small tables share a batch
                if len(held[0]) >= ROWS_AT_ONCE:
                    yield batch(*held)
                    held = ([], [], [])
        if held[0]:
            yield batch(*held)

    named = tables.select(F.col(run).alias("run"), F.col(path).alias("path"))
    dealt = named.repartition(named.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInArrow(parsed, "run string, row_no int, values map<string,string>")


def value_of(values: Column, aliases: list[str]) -> Column:
    """The finite number under the first name that a row's file has; null if it has none of them."""
    out = F.lit(None).cast("double")
    for a in reversed(aliases):
        out = F.when(F.map_contains_key(values, a), number(F.try_element_at(values, F.lit(a)))).otherwise(out)
    return out


def run_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """``run, mark`` and the columns of ``paths`` for the files that make or belong to a run's folder."""
    part = F.split(path, "/")
    name, parent = F.element_at(part, -1), F.coalesce(F.try_element_at(part, F.lit(-2)), F.lit(""))
    up = lambda n: F.array_join(F.slice(part, 1, F.greatest(F.size(part) - n, F.lit(0))), "/")
    weights = name.isin("best.pt", "last.pt") & (F.lower(parent) == "weights")
    mark = (
        F.when(name == "results.csv", "results").when(name == "args.yaml", "args")
        .when(weights & (parent == "weights"), F.regexp_extract(name, "^[a-z]+", 0)).when(weights, "other")
    )
    return paths.withColumn("run", F.when(weights, up(2)).otherwise(up(1))).withColumn("mark", mark).filter("mark is not null")


def inventory(spark: SparkSession, root: str, aliases: list[str], extra: dict[str, list[str]] | None = None) -> DataFrame:
    """The runs below ``root``, the newest first: ``run, updated, has_results, has_best, has_last,
    n_epochs, epoch`` (of the best row by ``aliases``, the first of equals), ``best`` and ``last_value``,
    and for each name of ``extra`` its value in the best row.

    A run's folder holds a result table or weights. Files are listed by executors; rows keep their place
    in their file, so the best and the last row of a run are aggregates and nothing is sorted for them.
    """
    if not exists(spark, root):
        files = spark.createDataFrame([], LISTING)
    else:
        files = listed(spark, root)
    marked = run_files(files)
    has = lambda m: F.bool_or(F.col("mark") == m)
    known = F.when(F.col("mark") != "other", F.col("modified"))
    runs = marked.groupBy("run").agg(
        F.max(known).alias("updated"), has("results").alias("has_results"), has("best").alias("has_best"), has("last").alias("has_last"),
        F.bool_or(F.col("mark") != "args").alias("_is_run"),
    ).filter("_is_run and updated is not null").drop("_is_run")
    rows = run_rows(marked.filter("mark = 'results'").select("run", "path"))
    extra = extra or {}
    judged = rows.select(
        "run", "row_no", value_of(F.col("values"), aliases).alias("m"), F.try_element_at("values", F.lit("epoch")).alias("epoch"),
        *[value_of(F.col("values"), a).alias(f"x{i}") for i, a in enumerate(extra.values())],
    )
    own = F.struct("epoch", "m", *[f"x{i}" for i in range(len(extra))])
    per = judged.groupBy("run").agg(
        F.count(F.lit(1)).alias("n_epochs"), F.max_by(own, F.when(F.col("m").isNotNull(), F.struct("m", (-F.col("row_no")).alias("r")))).alias("b"),
        F.max_by("m", "row_no").alias("last_value"),
    )
    done = runs.join(per, "run", "left").select(
        "run", "updated", "has_results", "has_best", "has_last", F.coalesce("n_epochs", F.lit(0)).alias("n_epochs"),
        F.col("b.epoch").alias("epoch"), F.col("b.m").alias("best"), "last_value", *[F.col(f"b.x{i}").alias(n) for i, n in enumerate(extra)],
    )
    return done.orderBy(F.desc("updated"), "run")


def run_folders(paths: DataFrame, path: str = "path") -> DataFrame:
    """Folders that hold a result table or weights, with what they hold."""
    marks = "|".join(m.replace(".", r"\.") for m in MARKS)
    hit = F.regexp_extract(path, rf"^(.*)/({marks})$", 1)
    mark = F.regexp_extract(path, rf"^(.*)/({marks})$", 2)
    return paths.select(hit.alias("run"), mark.alias("mark")).filter("run != ''").groupBy("run").agg(F.array_sort(F.collect_set("mark")).alias("marks"))
