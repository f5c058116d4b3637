"""Class maps and what the classes of a record's labels say about the record.

A class map is a table ``source, source_class, target_class, role`` with role target, negative
or unsupported; it is small by nature (classes of a label set), and is broadcast only after its
size has been checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Class maps of up to so many rows are broadcast.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def remap(labels: DataFrame, class_map: DataFrame, on: list[str], source: str | None = None) -> DataFrame:
    """``labels`` with ``target_class`` and ``role``, null where the map has nothing.

    With ``source`` (one of ``on``), a label of a source that the map doesn't know at all is an error when run.
    """
    joined = labels.join(small(class_map), on, "left")
    if source is None:
        return joined
    known = class_map.select(F.col(source).alias("_known")).distinct()
    checked = joined.join(small(known), F.col(source) == F.col("_known"), "left")
    lost = F.raise_error(F.concat(F.lit("unknown source: "), F.coalesce(F.col(source).cast("string"), F.lit("null"))))
    return checked.withColumn("role", F.when(F.col("_known").isNull(), lost.cast("string")).otherwise(F.col("role"))).drop("_known")


def decision(targets: Column, negatives: Column, others: Column, any_label: Column) -> Column:
    """empty, target, negative_candidate or ambiguous from what a record's labels hold."""
    return (
        F.when(~any_label, "empty")
        .when(targets & ~negatives & ~others, "target")
        .when(negatives & ~targets & ~others, "negative_candidate")
        .otherwise("ambiguous")
    )


def classify(labels: DataFrame, record: list[str], role: str = "role") -> DataFrame:
    """A row for each record with ``decision``, from labels with a role (null: unknown)."""
    is_role = lambda r: F.coalesce(F.bool_or(F.col(role) == r), F.lit(False))
    seen = labels.groupBy(*record).agg(
        is_role("target").alias("t"),
        is_role("negative").alias("n"),
        F.bool_or(F.col(role).isNull() | ~F.col(role).isin("target", "negative")).alias("o"),
    )
    return seen.select(*record, decision(F.col("t"), F.col("n"), F.col("o"), F.lit(True)).alias("decision"))


def target_annotations(labels: DataFrame, record: list[str], keep: list[str]) -> DataFrame:
    """The labels of records that are all target, gathered for each record in order of ``keep``.

    A record's labels are few (those of one image), so the array is bounded by the record.
    """
    decided = classify(labels, record).filter("decision = 'target'").select(*record)
    return labels.join(decided, record, "left_semi").groupBy(*record).agg(
        F.sort_array(F.collect_list(F.struct(*keep))).alias("annotations")
    )


def drop_reasons(
    labels: DataFrame, record: list[str], valid: str, tokens: str, role: str = "role",
    preserve_empty: bool = False, reject_other_formats: bool = True, exclude_unsupported: bool = True,
) -> DataFrame:
    """A row for each record with its ``drop_reason``, null where it is kept.

    In this order: ``empty_label`` if a record has no line (unless ``preserve_empty``),
    ``non_detection_label`` if a line hasn't five tokens, ``unsupported_class`` if any class is
    unsupported, ``unknown_class`` if a class is in no map. Lines with a null ``valid`` column
    stand for records without lines.
    """
    flags = labels.groupBy(*record).agg(
        F.bool_and(F.col(valid).isNull()).alias("empty"),
        F.coalesce(F.bool_or((F.col(tokens) != 5) & F.col(valid).isNotNull()), F.lit(False)).alias("other"),
        F.coalesce(F.bool_or(F.col(role) == "unsupported"), F.lit(False)).alias("unsupported"),
        F.coalesce(F.bool_or(F.col(role).isNull() & F.col(valid).isNotNull()), F.lit(False)).alias("unknown"),
    )
    reason = (
        F.when(F.col("empty"), F.lit(None) if preserve_empty else F.lit("empty_label"))
        .when(F.col("other") & F.lit(reject_other_formats), F.lit("non_detection_label"))
        .when(F.col("unsupported") & F.lit(exclude_unsupported), F.lit("unsupported_class"))
        .when(F.col("unknown"), F.lit("unknown_class"))
    )
    return flags.select(*record, reason.cast("string").alias("drop_reason"))


def core_and_reject(labels: DataFrame, record: list[str], target: str = "target_class") -> DataFrame:
    """``core`` (mapped classes only), ``reject`` (unmapped only) or ``mixed`` for each record,
    with its distinct sorted classes."""
    seen = labels.groupBy(*record).agg(
        F.array_sort(F.collect_set(target)).alias("classes"), F.bool_or(F.col(target).isNull()).alias("unknown")
    )
    part = F.when(F.size("classes") == 0, "reject").when(F.col("unknown"), "mixed").otherwise("core")
    return seen.select(*record, "classes", part.alias("part"))
