"""Counts, reports and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_counts(lines: DataFrame, parsed: str) -> DataFrame:
    """One row with valid, box, polygon and invalid lines of a parsed-line column."""
    ok = F.col(parsed)["error"].isNull()
    kind = F.col(parsed)["kind"]
    return lines.agg(
        F.count_if(ok).alias("valid_lines"), F.count_if(kind == "bbox").alias("box_lines"),
        F.count_if(kind == "polygon").alias("polygon_lines"), F.count_if(~ok).alias("invalid_lines"),
    )


def class_counts(lines: DataFrame, parsed: str) -> DataFrame:
    """``class_id, lines`` over the valid lines."""
    # counted, not filtered: a filter would be pushed below the parsing and repeat it
    valid = F.count_if(F.col(parsed)["error"].isNull()).alias("lines")
    return lines.groupBy(F.col(parsed)["class_id"].alias("class_id")).agg(valid).filter("lines > 0")


def zero_filled(counts: DataFrame, key: str, values: list, count: str) -> DataFrame:
    """A row for each of ``values``, with 0 where ``counts`` has none."""
    kind = counts.schema[key].dataType.simpleString()
    every = counts.sparkSession.createDataFrame([(v,) for v in values], f"{key} {kind}")
    return every.join(counts, key, "left").withColumn(count, F.coalesce(count, F.lit(0)))


def by_split(records: DataFrame, row: str, split: str, splits: list[str]) -> DataFrame:
    """Records by ``row`` with a column for each split and their total."""
    table = records.groupBy(row).pivot(split, splits).count().na.fill(0)
    total = sum((F.col(s) for s in splits), F.lit(0))
    return table.withColumn("total", total)


def rolled_up(records: DataFrame, columns: list[str]) -> DataFrame:
    return records.rollup(*columns).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def duplicate_lines(lines: DataFrame, record: list[str], line: str, cls: str) -> tuple[DataFrame, DataFrame]:
    """One row (records with repeats, repeated lines), and repeated lines by class."""
    again = lines.groupBy(*record, line, cls).agg((F.count(F.lit(1)) - 1).alias("again"))
    whole = again.groupBy(*record).agg(F.sum("again").alias("again")).agg(
        F.count_if(F.col("again") > 0).alias("records"), F.coalesce(F.sum("again"), F.lit(0)).alias("lines")
    )
    return whole, again.groupBy(cls).agg(F.sum("again").alias("lines")).filter("lines > 0")


def leakage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys and repeated rows on each side, and keys on both."""
    n = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    both = n(left, "a").join(n(right, "b"), key, "full_outer")
    return both.agg(
        F.count("a").alias("left_keys"), F.count("b").alias("right_keys"),
        F.count_if(F.col("a") > 1).alias("left_groups"), F.count_if(F.col("b") > 1).alias("right_groups"),
        F.coalesce(F.sum(F.col("a") - 1), F.lit(0)).alias("left_extra"), F.coalesce(F.sum(F.col("b") - 1), F.lit(0)).alias("right_extra"),
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared_keys"),
    )


def best_and_last(rows: DataFrame, run: list[str], metric: str, index: list[str]) -> DataFrame:
    """For each run its rows, the index of its best row (the first of equals) and its last values."""
    place = F.struct(*index)
    finite = F.when(~F.isnan(metric) & (F.abs(metric) < float("inf")), F.col(metric))
    best = F.max_by(F.struct(*index, metric), F.when(finite.isNotNull(), F.struct(finite.alias("m"), *[(-F.col(i).cast("double")).alias(f"i{k}") for k, i in enumerate(index)])))
    return rows.groupBy(*run).agg(F.count(F.lit(1)).alias("rows"), best.alias("best"), F.max_by(metric, place).alias("last_value"))


def preflight(lines: DataFrame, by: list[str], record: str, parsed: str) -> DataFrame:
    """Records, empty records, annotations and invalid lines for each group."""
    has = F.col(parsed).isNotNull()
    bad = has & F.col(parsed)["error"].isNotNull()
    per = lines.groupBy(*by, record).agg(F.count_if(has).alias("n"), F.count_if(bad).alias("bad"))
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("n") == 0).alias("empty_records"),
        F.sum("n").alias("annotations"), F.sum("bad").alias("invalid_lines"),
    )


def audited(lines: DataFrame, split: str, record: str, parsed: str) -> DataFrame:
    """``split, records, lines, invalid_lines`` of a parsed-line column."""
    return lines.groupBy(F.col(split).alias("split")).agg(
        F.count_distinct(record).alias("records"), F.count(F.lit(1)).alias("lines"), F.count_if(F.col(parsed)["error"].isNotNull()).alias("invalid_lines")
    )


def result_record(rows: DataFrame, run: str, cls: str, value: str, classes: list[str]) -> DataFrame:
    """One row a run: mean, best and number of its values, and the best of each class, null where it has none."""
    own = [F.max(F.when(F.col(cls) == c, F.col(value))).alias(c) for c in classes]
    return rows.groupBy(run).agg(F.avg(value).alias("mean_value"), F.max(value).alias("best_value"), F.count(F.lit(1)).alias("n"), *own)


def confident(detections: DataFrame, confidence: str, least: float) -> DataFrame:
    """Detections of at least ``least`` confidence."""
    return detections.filter(F.col(confidence) >= least)


def records_with_class(records: DataFrame, key: str, classes: str) -> DataFrame:
    """For each class the records that have it and the annotations of it; ``key`` is unique."""
    each = records.select(F.col(key).alias("r"), F.explode(classes).alias("class_id"))
    per = each.groupBy("class_id", "r").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("class_id").agg(F.count(F.lit(1)).alias("records"), F.sum("n").alias("annotations"))


def grouped(records: DataFrame, family: str, keep: list[str]) -> DataFrame:
    """Families with their members in order; a family is small by nature (copies of a picture)."""
    return records.groupBy(family).agg(F.sort_array(F.collect_list(F.struct(*keep))).alias("members"))


def ranked_detections(detections: DataFrame, confidence: str, index: str, least: float = 0.25) -> DataFrame:
    """Detections of at least ``least`` confidence, best first, equals by ``index``."""
    return detections.filter(F.col(confidence) >= least).orderBy(F.desc(confidence), index)


def best_detection(detections: DataFrame, by: list[str], confidence: str, index: str, keep: list[str]) -> DataFrame:
    """The first detection of the highest confidence for each group."""
    order = F.struct(F.col(confidence), -F.col(index))
    return detections.groupBy(*by).agg(F.max_by(F.struct(*keep), order).alias("best")).select(*by, "best.*")


def first_matching(rows: DataFrame, path: str, pattern: str, order: list[Column]) -> DataFrame:
    return rows.filter(F.col(path).rlike(pattern)).orderBy(*order).limit(1)


#: Base-2 logarithm of the entries of a key sketch.
SKETCH = 12


def key_sketches(records: DataFrame, split: str, key: str, size: int = SKETCH) -> DataFrame:
    """``split, sketch``: a mergeable sketch of each split's distinct keys, made in one pass."""
    return records.groupBy(F.col(split).alias("split")).agg(F.theta_sketch_agg(F.col(key).cast("string"), size).alias("sketch"))


def overlap_estimates(sketches: DataFrame, size: int = SKETCH) -> DataFrame:
    """``left, right, left_keys, right_keys, shared_keys, bound`` for each two splits, from sketches alone.

    Counts are estimates; the shared keys differ from the true number by at most ``bound`` in all but
    about one of 400 cases (three standard errors of a sketch, of the keys of both). Exact where both
    splits have fewer keys than a sketch has entries. Splits are few by nature; null is a split of its own.
    """
    every = sketches.agg(F.sort_array(F.collect_list(F.struct("split", "sketch"))).alias("s"))
    pairs = every.select("s", F.posexplode("s").alias("i", "a")).select("i", "a", F.posexplode("s").alias("j", "b")).filter("i < j")
    a, b = F.col("a.sketch"), F.col("b.sketch")
    union = F.theta_sketch_estimate(F.theta_union(a, b, size))
    return pairs.select(
        F.col("a.split").alias("left"), F.col("b.split").alias("right"), F.theta_sketch_estimate(a).alias("left_keys"), F.theta_sketch_estimate(b).alias("right_keys"),
        F.theta_sketch_estimate(F.theta_intersection(a, b)).alias("shared_keys"),
        F.when(union < 2**size, F.lit(0).cast("long")).otherwise(F.ceil(union * (3 / 2 ** (size / 2)))).alias("bound"),
    )
