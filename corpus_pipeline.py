"""A training-data pipeline over ``documents``; each stage reads what the one before it wrote.

Cases: a document with a null, empty or letterless text goes in the first stage, and so does one of an
unlikely language. Without a labelled language all go. Of equal rows one stays in the second stage; ids
may repeat or be null, and rows are told apart by id and text there. A benchmark without items drops
nothing. Masks leave null texts null. Empty tables pass through all stages. Columns beyond those of
``documents`` are kept to the end, where ``copy`` is added under a name that is free.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm import decontam, langid, mixing, pii, simhash
from siftwork.llm.common import held_out, shared_dir, unused

#: A document goes if its text has no letter, or its language is less likely than this.
LEAST_LANGUAGE_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language."""
    model = langid.fit(docs, ~held_out())
    (name,) = unused(docs, "language_guess")
    seen = docs.withColumn(name, langid.language(docs, model))
    known = (F.col(name)["lang_pred"] != langid.UND) & (F.col(name)["score"] >= LEAST_LANGUAGE_SCORE)
    return seen.filter(known).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontam.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts; ``n_chars`` follows where the table has it."""
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target asks for, numbered by ``copy``."""
    return mixing.mixed(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("personal_data", personal_data),
    ("mixed", mixed),
]
#: Language models, fingerprints and a sampling plan aren't expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the others' are written to the shared folder and read again.

    A stage's rows are deleted once the next one's are written; those that the result reads stay.
    """
    folder, before = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}", None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
