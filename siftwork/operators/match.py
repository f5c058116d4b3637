"""Joins: pairing, protection of held-out records, leakage between splits, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .classify import small

PERCEPTUAL = ["dhash", "width", "height"]


def pair(images: DataFrame, labels: DataFrame, on: list[str]) -> DataFrame:
    """Both sides by ``on``, with ``pairing``: paired, image_only or label_only."""
    left, right = images.withColumn("has_image", F.lit(True)), labels.withColumn("has_label", F.lit(True))
    state = F.when(F.col("has_label").isNull(), "image_only").when(F.col("has_image").isNull(), "label_only").otherwise("paired")
    return left.join(right, on, "full_outer").withColumn("pairing", state).drop("has_image", "has_label")


def fingerprints(protected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct exact and perceptual keys of protected records."""
    return protected.select("sha256").distinct(), protected.select(*PERCEPTUAL).distinct()


def protected_keys(protected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct perceptual keys of protected records, and one row ``records, unreadable, keys``."""
    read = F.col("dhash").isNotNull()
    keys = protected.filter(read).select(*PERCEPTUAL).distinct()
    counts = protected.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(~read).alias("unreadable"),
        F.count_distinct(F.when(read, F.struct(*PERCEPTUAL))).alias("keys"),
    )
    return keys, counts


def match_kind(records: DataFrame, protected: DataFrame) -> DataFrame:
    """``records`` with ``match``: exact, perceptual or null. Exact wins."""
    exact, like = fingerprints(protected)
    # how many keys there are is known to Spark once they are made, and it broadcasts them if they are few
    exact = exact.filter("sha256 is not null").withColumn("hit_exact", F.lit(True))
    like = like.dropna().withColumn("hit_like", F.lit(True))
    joined = records.join(exact, "sha256", "left").join(like, PERCEPTUAL, "left")
    kind = F.when(F.col("hit_exact"), "exact").when(F.col("hit_like"), "perceptual")
    return joined.withColumn("match", kind).select(*records.columns, "match")


def protect(records: DataFrame, protected: DataFrame) -> DataFrame:
    """``records`` that match no protected one."""
    return match_kind(records, protected).filter("match is null").drop("match")


def exclude_keys(records: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """``records`` whose key isn't one of ``others``'."""
    return records.join(others.select(key).distinct(), key, "left_anti")


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on both sides with the number of rows on each."""
    count = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return count(left, "left_rows").join(count(right, "right_rows"), key)


def compare(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Both values by key, null where one side has none, and the change."""
    a = before.select(key, F.col(value).alias("before"))
    b = after.select(key, F.col(value).alias("after"))
    return a.join(b, key, "full_outer").withColumn("change", F.col("after") - F.col("before"))


def coco_labels(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Annotations with their image and, where there is one, their category's name."""
    i = images.select(F.col("id").alias("image_id"), "file_name", "width", "height")
    c = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category"))
    return annotations.join(i, "image_id").join(small(c), "category_id", "left")


def disjoint(left: DataFrame, right: DataFrame, key: str | Column) -> bool:
    """True if no key is on both sides."""
    return left.select(key).intersect(right.select(key)).isEmpty()
