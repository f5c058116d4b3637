"""Exact and perceptual duplicates: which row stays, and counts of what goes.

The rows that stay are the first of each perceptual key in an explicit, unique order: rows with
equal content have equal perceptual keys, so a pass over content before it removes nothing more.
Only counts differ between the two ways to count (``two_passes`` and ``one_pass``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .match import PERCEPTUAL, match_kind


def first_of_each(records: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in ``order``, by a mergeable minimum: no group is sorted.

    Columns of ``order`` must be comparable and make rows distinct.
    """
    names = records.columns
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    best = F.min_by(F.struct(*names), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return records.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(best.alias("first")).select("first.*")


def priority_of(source: Column, priority: list[str]) -> Column:
    """A source's place in ``priority``; a source that isn't there raises an error when run."""
    places = F.create_map(*[F.lit(x) for i, s in enumerate(priority) for x in (s, i)])
    place = F.try_element_at(places, source)
    return F.coalesce(place, F.raise_error(F.concat(F.lit("source without priority: "), source)).cast("int"))


def deduplicate(records: DataFrame, order: list[Column | str], key: list[str] = PERCEPTUAL) -> DataFrame:
    return first_of_each(records, key, order)


def two_passes(records: DataFrame, content: str, key: list[str]) -> DataFrame:
    """Counts when rows of equal content go first: one row ``exact, perceptual, kept``."""
    n = records.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(F.struct(content)).alias("contents"),
        F.count_distinct(F.struct(*key)).alias("kept"),
    )
    return n.select((F.col("n") - F.col("contents")).alias("exact"), (F.col("contents") - F.col("kept")).alias("perceptual"), "kept")


def one_pass(records: DataFrame, content: str, key: list[str], order: list[Column | str]) -> DataFrame:
    """Counts when each row is held against the row that was kept for its key: a row is an exact
    duplicate if it has the kept row's content, else a perceptual one."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    per = (
        records.groupBy(*key, F.col(content).alias("c"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("o"))
        .groupBy(*key)
        .agg(F.sum("n").alias("n"), F.min_by("n", "o").alias("same"))
    )
    return per.agg(
        F.coalesce(F.sum(F.col("same") - 1), F.lit(0)).alias("exact"),
        F.coalesce(F.sum(F.col("n") - F.col("same")), F.lit(0)).alias("perceptual"),
        F.count(F.lit(1)).alias("kept"),
    )


def exclude_and_deduplicate(records: DataFrame, protected: DataFrame, order: list[Column | str]) -> DataFrame:
    """``records`` with ``drop_reason``: unreadable, benchmark_exact, benchmark_perceptual,
    duplicate_exact, duplicate_perceptual or null for the rows that stay, in that order of checks.

    A record without a perceptual key is unreadable, whatever its content, and holds no key."""
    order = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])
    matched = match_kind(records, protected).withColumn("_order", order)
    # a mergeable minimum for each key, so that a key that many rows share needn't be sorted
    held = matched.filter("match is null and dhash is not null").groupBy(*PERCEPTUAL).agg(F.min(F.struct(F.col("_order").alias("o"), F.col("sha256").alias("sha"))).alias("_held"))
    keys = held.withColumnsRenamed({c: f"_{c}" for c in PERCEPTUAL})
    same = F.col("match").isNull()
    for c in PERCEPTUAL:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    reason = (
        F.when(F.col("dhash").isNull(), "unreadable")
        .when(F.col("match") == "exact", "benchmark_exact")
        .when(F.col("match") == "perceptual", "benchmark_perceptual")
        .when(F.col("_order").eqNullSafe(F.col("_held")["o"]), F.lit(None).cast("string"))
        .when(F.col("sha256").eqNullSafe(F.col("_held")["sha"]), "duplicate_exact")
        .otherwise("duplicate_perceptual")
    )
    return matched.join(keys, same, "left").withColumn("drop_reason", reason).select(*records.columns, "drop_reason")


def distinct_annotations(lines: DataFrame, record: list[str], line: str, order: str) -> DataFrame:
    """Lines without those equal to an earlier one of their record."""
    return first_of_each(lines, [*record, line], [order])
