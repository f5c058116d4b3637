"""Dataset builds as compositions of the operators.

The order of steps is part of each build's meaning, so the builds are written out: the newest
caps negatives, then protects benchmarks, removes duplicates and splits by records; the one
before it protects and deduplicates in one go, then caps and splits by families; the oldest lets
the validation side own its keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import output_name
from ..operators import dedup, match, select
from ..sources.storage import shared_folder, stored

MODES = ("cap_first", "cap_last")


@dataclass
class Build:
    """``kept`` has final_split; ``dropped`` has every other record with its drop_reason."""

    kept: DataFrame
    dropped: DataFrame


def build(
    records: DataFrame, protected: DataFrame, priority: list[str], negative_fraction: float, valid_fraction: float,
    seed: int, mode: str = "cap_first",
) -> Build:
    """Records have: id, source, family_id, image_path, is_negative, sha256, dhash, width, height."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    order = [dedup.priority_of(F.col("source"), priority), "source", "image_path"]
    # both are read many times, by counts, caps, splits and what is dropped: keys are made once
    folder = shared_folder(records.sparkSession, "build")
    records, protected = stored(records, f"{folder}/records"), stored(protected.select("sha256", *match.PERCEPTUAL), f"{folder}/protected")
    if mode == "cap_first":
        capped = select.cap_negatives(records, "is_negative", "id", negative_fraction, seed)
        over = records.join(capped.select("id"), "id", "left_anti").withColumn("drop_reason", F.lit("negative_cap"))
        tagged = stored(dedup.exclude_and_deduplicate(capped, protected, order), f"{folder}/tagged")
        final = tagged.filter("drop_reason is null").drop("drop_reason")
        split = select.split_by_records(final, "family_id", "source", valid_fraction, seed)
    else:
        tagged = stored(dedup.exclude_and_deduplicate(records, protected, order), f"{folder}/tagged")
        unique = tagged.filter("drop_reason is null").drop("drop_reason")
        final = select.cap_negatives(unique, "is_negative", "id", negative_fraction, seed)
        over = unique.join(final.select("id"), "id", "left_anti").withColumn("drop_reason", F.lit("negative_cap"))
        split = select.split_by_families(final, "family_id", "source", valid_fraction, seed)
    sides = split.select(F.col("family").alias("family_id"), F.col("split").alias("final_split"))
    named = final.join(sides, "family_id").withColumn("output_name", output_name(F.col("source"), F.col("sha256"), F.col("image_path")))
    dropped = over.unionByName(tagged.filter("drop_reason is not null"))
    return Build(named, dropped)


def leakage_safe(train: DataFrame, valid: DataFrame, key: str, order: str) -> Build:
    """The oldest build: valid owns its keys, one row each."""
    rest, owned = select.validation_plan(train, valid, key, order)
    kept = rest.withColumn("final_split", F.lit("train")).unionByName(owned.withColumn("final_split", F.lit("valid")))
    lost = match.exclude_keys(train, rest, order).withColumn("drop_reason", F.lit("in_valid"))
    doubled = match.exclude_keys(valid, owned, order).withColumn("drop_reason", F.lit("same_key"))
    return Build(kept, lost.unionByName(doubled))


def benchmark(
    candidates: DataFrame, training: DataFrame, key: str, dhash: str, classes: str, first_source: str, target: int, seed: int,
    first_share: float, class_ids: list[int],
) -> DataFrame:
    """A balanced benchmark of candidates whose hash isn't in training, one for each hash."""
    clean = match.exclude_keys(candidates, training, dhash)
    unique = dedup.first_of_each(clean, [dhash], [key])
    if unique.count() < target:
        raise ValueError("fewer clean candidates than the target")
    return select.balanced(unique, key, classes, F.col("source") == first_source, target, seed, first_share, class_ids)


def summary(done: Build) -> DataFrame:
    """Counts by source and final split, drops as ``dropped:<reason>``."""
    kept = done.kept.groupBy("source", F.col("final_split").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    gone = done.dropped.groupBy("source", F.concat(F.lit("dropped:"), "drop_reason").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    return kept.unionByName(gone)
