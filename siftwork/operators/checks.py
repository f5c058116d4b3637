"""Invariants of a finished dataset: violations as rows, failure codes, preflight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import in_unit, read_line, share
from .match import match_kind, pair

#: The failure codes of a label line, a format that reports share.
LINE_CODES = (
    "non_five_token_label", "invalid_label_value", "invalid_class_id",
    "invalid_x_center", "invalid_y_center", "invalid_width", "invalid_height",
)


def line_rules(classes: list[int]) -> dict[str, Column]:
    """What breaks each rule, by code, over the columns of ``read_line``."""
    v = [F.col(f"_v{k}") for k in range(1, 5)]
    plain = F.col("_n") == 5
    unread = F.col("_class").isNull() | v[0].isNull() | v[1].isNull() | v[2].isNull() | v[3].isNull()
    rules = (
        ~plain, plain & unread, plain & ~unread & ~F.col("_class").isin(classes), plain & ~unread & ~in_unit(v[0]),
        plain & ~unread & ~in_unit(v[1]), plain & ~unread & ~share(v[2]), plain & ~unread & ~share(v[3]),
    )
    return dict(zip(LINE_CODES, rules))


def label_violations(lines: DataFrame, line: str, classes: list[int]) -> DataFrame:
    """``code, n`` over all label lines, in one pass that reads each line once."""
    counts = read_line(lines.select(line), line, mode="digits").agg(*[F.count_if(bad).alias(code) for code, bad in line_rules(classes).items()])
    every = F.array(*[F.struct(F.lit(code).alias("code"), F.col(code).alias("n")) for code in LINE_CODES])
    return counts.select(F.explode(every).alias("x")).select("x.*").filter("n > 0")


def split_violations(records: DataFrame, split: str, keys: dict[str, list[str]]) -> DataFrame:
    """``code, n`` for each code of ``keys``: values of its columns found in more than one split."""
    parts = []
    for code, columns in keys.items():
        seen = records.groupBy(*columns).agg(F.count_distinct(split).alias("k")).filter("k > 1")
        parts.append(seen.agg(F.count(F.lit(1)).alias("n")).select(F.lit(code).alias("code"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("n > 0")


def failure_codes(*violations: DataFrame) -> list[str]:
    """Sorted distinct codes; a fixed set of rules bounds them."""
    every = violations[0].select("code")
    for v in violations[1:]:
        every = every.unionByName(v.select("code"))
    return [r["code"] for r in every.distinct().orderBy("code").collect()]


def protected_violations(records: DataFrame, protected: DataFrame) -> DataFrame:
    """``code, n`` of records whose content or perceptual key is a protected record's."""
    kinds = match_kind(records, protected).filter("match is not null")
    code = F.concat(F.lit("benchmark_"), "match", F.lit("_overlap"))
    return kinds.groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"))


def pairing_violations(images: DataFrame, labels: DataFrame, on: list[str]) -> DataFrame:
    """``code, n`` of images without a label file and of label files without an image."""
    code = F.when(F.col("pairing") == "image_only", "missing_label_file").when(F.col("pairing") == "label_only", "missing_image_file")
    return pair(images, labels, on).select(code.alias("code")).filter("code is not null").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def dataset_violations(
    records: DataFrame, split: str, keys: dict[str, list[str]], protected: DataFrame, lines: DataFrame, line: str, classes: list[int],
    images: DataFrame, labels: DataFrame, on: list[str],
) -> DataFrame:
    """All rules of a finished dataset as one table ``code, n``: lines, splits, protection, pairing."""
    return (
        label_violations(lines, line, classes).unionByName(split_violations(records, split, keys))
        .unionByName(protected_violations(records, protected)).unionByName(pairing_violations(images, labels, on))
    )


def unequal_counts(images: DataFrame, labels: DataFrame, split: str, image: str, label: str) -> DataFrame:
    """``split, images, label_files`` of the splits that don't have as many of one as of the other."""
    i = images.groupBy(split).agg(F.count_distinct(image).alias("images"))
    l = labels.groupBy(split).agg(F.count_distinct(label).alias("label_files"))
    both = i.join(l, split, "full_outer").na.fill(0, ["images", "label_files"])
    return both.filter("images <> label_files")


def built_violations(
    images: DataFrame, labels: DataFrame, lines: DataFrame, manifest: DataFrame, split: str, image: str, label: str, cls: str, n_classes: int, family: str
) -> DataFrame:
    """``code, n`` of the weaker rules: counts of files by split, class range, families of the manifest in several splits."""
    counts = unequal_counts(images, labels, split, image, label).agg(F.count(F.lit(1)).alias("n")).select(F.lit("unequal_counts").alias("code"), "n")
    outside = F.coalesce(~F.col(cls).between(0, n_classes - 1), F.lit(True))
    range_ = lines.agg(F.count_if(outside).alias("n")).select(F.lit("class_out_of_range").alias("code"), "n")
    return counts.unionByName(range_).filter("n > 0").unionByName(split_violations(manifest, split, {"family_leakage": [family]}))


def absent_classes(counts: DataFrame, key: str, count: str) -> DataFrame:
    return counts.filter(F.col(count) == 0).select(key)


def require_classes(found: DataFrame, order: str, name: str, expected: list[str]) -> DataFrame:
    """``found`` if its names, in ``order``, are the expected ones; a class list is small by nature."""
    names = [r[name] for r in found.select(order, name).orderBy(order).limit(len(expected) + 1).collect()]
    if names != expected:
        raise ValueError(f"expected classes {expected}, found {names}")
    return found


def require_rows(df: DataFrame, n: int) -> DataFrame:
    """``df`` if it has exactly ``n`` rows."""
    found = df.count()
    if found != n:
        raise ValueError(f"expected {n} rows, found {found}")
    return df
