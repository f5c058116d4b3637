"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A document is held out of every fit if crc32 of its id, as text, leaves this remainder.
HELD_OUT_FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold that no model learns from. A null id counts as the text ''."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(HELD_OUT_FOLDS)) == 0


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and the master is local, as in tests, is a temporary folder used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="siftwork-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as files in the shared folder, with its lineage cut."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """For each name a column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def sample_by_class(df: DataFrame, key: str, cls: str, bound: int, salt: str) -> tuple[DataFrame, dict[str, int]]:
    """About ``bound`` rows of each value of ``cls``; every value with a row is kept.

    A row is taken if a hash of its key falls below bound / count of its class, so the sample
    is the same in every run and its expected size is bounded whatever the size of ``df``.
    Also returns the counts by class: one row a class comes to the driver.
    """
    named = df.filter(F.col(cls).isNotNull()).withColumn(cls, F.col(cls).cast("string"))
    counts = named.groupBy(cls).count()
    sizes = {r[cls]: r["count"] for r in counts.collect()}
    scale = 1 << 30
    draw = F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(scale))
    if not sizes:
        return df.filter(F.lit(False)), {}
    limits = F.create_map(*[F.lit(x) for c, n in sorted(sizes.items()) for x in (c, min(scale, bound * scale // n))])
    return df.filter(draw < F.try_element_at(limits, F.col(cls).cast("string"))), sizes


def by_weight(
    texts: pd.Series, most_chars: int
) -> Iterator[tuple[int, int]]:
    """Slices of ``texts`` that hold at most ``most_chars`` characters, or one text each."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > start and held + n > most_chars:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def per_row(kernel: Callable[[pd.Series], pd.DataFrame], schema: str, text: Column) -> Column:
    """A struct column that ``kernel`` makes from batches of ``text``."""

    @F.pandas_udf(schema)
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield kernel(texts)

    return udf(text)


def new_folder(spark: SparkSession, name: str) -> str:
    """A name for a new folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str) -> DataFrame:
    """``df`` as a Parquet table: lineage ends there and it is computed once."""
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def discard(spark: SparkSession, *folders: str) -> None:
    """Deletes tables that nothing reads any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that have run: its cleaner follows the driver's
    garbage collection, which else comes when it likes."""
    spark._jvm.System.gc()
