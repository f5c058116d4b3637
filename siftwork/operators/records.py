"""From label lines to records: which images stay, why others go, and the lines they get.

Lines come as a table with the columns of ``record``, ``line_no`` and ``line``; a record without a
line has one row with a null line. A class map has ``source_class, target_class, role``. A record's
lines are few, those of one image, so gathering them is bounded by the record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import class_id, fixed8, parsed, read_line, tokens
from .classify import remap

UNKNOWN_MODES = ("drop", "error")
#: Fixed value: the name of the class that dataset reports without one.
UNNAMED = "BIODEGRADABLE"


def _text(cls: str, *numbers: str) -> Column:
    return F.concat_ws(" ", F.col(cls).cast("string"), *[fixed8(F.col(n)) for n in numbers])


def _lines(value: Column, wanted: Column) -> Column:
    """The wanted values of a record's rows in the order of their lines."""
    rows = F.collect_list(F.when(wanted, F.struct(F.col("line_no").alias("n"), value.alias("v"))))
    return F.transform(F.array_sort(rows), lambda x: x["v"])


def _named(class_map: DataFrame) -> DataFrame:
    return class_map.select(F.col("source_class").alias("_class"), "target_class", "role")


def remapped(
    lines: DataFrame, record: list[str], class_map: DataFrame, preserve_empty: bool = False,
    reject_other_formats: bool = True, exclude_unsupported: bool = True, on_unknown: str = "drop",
) -> DataFrame:
    """``labels, is_negative, drop_reason`` for each record: all of its lines remapped, or none.

    In this order: ``empty_label`` without a line (unless ``preserve_empty``), ``non_detection_label``
    if a line hasn't five tokens (an error unless ``reject_other_formats``), ``invalid_number``,
    ``unsupported_class`` and ``unknown_class`` if any line has such a class (an error if
    ``on_unknown`` says so). Numbers are written with eight decimals; ranges aren't checked here.
    """
    if on_unknown not in UNKNOWN_MODES:
        raise ValueError(f"on_unknown must be one of {UNKNOWN_MODES}")
    v = [f"_v{k}" for k in range(1, 5)]
    read = remap(read_line(lines, "line", mode="digits"), _named(class_map), ["_class"])
    has = F.col("line").isNotNull()
    unread = F.col("_class").isNull()
    for k in v:
        unread |= F.col(k).isNull()
    unsupported = (F.col("role") == "unsupported") & F.lit(exclude_unsupported)
    any_of = lambda c: F.coalesce(F.bool_or(has & c), F.lit(False))
    unknown = F.col("target_class").isNull() & ~F.coalesce(unsupported, F.lit(False))
    per = read.groupBy(*record).agg(
        F.bool_and(~has).alias("empty"), any_of(F.col("_n") != 5).alias("other"), any_of(unread).alias("unread"),
        any_of(unsupported).alias("unsupported"), any_of(unknown).alias("unknown"),
        _lines(F.struct("target_class", *v), has).alias("rows"),
    )
    fail = lambda on, name: F.when(F.lit(on), F.raise_error(F.lit(name))).otherwise(F.lit(name)).cast("string")
    reason = (
        F.when(F.col("empty"), F.lit(None) if preserve_empty else F.lit("empty_label"))
        .when(F.col("other"), fail(not reject_other_formats, "non_detection_label"))
        .when(F.col("unread"), F.lit("invalid_number"))
        .when(F.col("unsupported"), F.lit("unsupported_class"))
        .when(F.col("unknown"), fail(on_unknown == "error", "unknown_class"))
    )
    judged = per.select(*record, "rows", reason.cast("string").alias("drop_reason"))
    written = judged.select(*record, "drop_reason", F.posexplode_outer(F.when(F.col("drop_reason").isNull(), F.col("rows"))).alias("line_no", "r"))
    flat = written.select(*record, "drop_reason", "line_no", "r.*")
    text = flat.withColumn("text", _text("target_class", *v))
    done = text.groupBy(*record, "drop_reason").agg(_lines(F.col("text"), F.col("line_no").isNotNull()).alias("labels"))
    return done.select(*record, "labels", (F.col("drop_reason").isNull() & (F.size("labels") == 0)).alias("is_negative"), "drop_reason")


def lenient(lines: DataFrame, record: list[str], class_map: DataFrame, has_label: str | None = None) -> DataFrame:
    """``labels, outcome`` for each record, by the rules of the build before the newest.

    ``outcome`` is missing_label (where the boolean column ``has_label`` is false), empty_label_skipped,
    invalid_or_unknown (a line that is neither box nor polygon, or a class that isn't in the map),
    ambiguous_mixed (mapped and ignored classes), negative (ignored classes only) or kept. Class
    tokens are cut off after the point, polygons become their boxes, equal lines are one.
    """
    box = F.col("p")
    read = parsed(lines, "line", "p", mode="truncate").withColumn("_class", box["class_id"])
    for k in "xywh":
        read = read.withColumn(k, box[k])
    joined = remap(read, _named(class_map), ["_class"])
    has = F.col("line").isNotNull()
    mapped, listed = F.col("target_class").isNotNull(), F.col("role").isNotNull()
    any_of = lambda c: F.coalesce(F.bool_or(has & c), F.lit(False))
    text = joined.withColumn("text", F.when(mapped, _text("target_class", *"xywh")))
    per = text.groupBy(*record).agg(
        (~F.first(has_label) if has_label else F.lit(False)).alias("missing"), F.bool_and(~has).alias("empty"),
        any_of(box["error"].isNotNull() | ~listed).alias("invalid"), any_of(mapped).alias("t"), any_of(listed & ~mapped).alias("n"),
        F.array_distinct(_lines(F.col("text"), has & mapped)).alias("labels"),
    )
    outcome = (
        F.when(F.col("missing"), "missing_label").when(F.col("empty"), "empty_label_skipped").when(F.col("invalid"), "invalid_or_unknown")
        .when(F.col("t") & F.col("n"), "ambiguous_mixed").when(F.col("n"), "negative").otherwise("kept")
    )
    keep = outcome.isin("kept")
    return per.select(*record, F.when(keep, F.col("labels")).otherwise(F.array().cast("array<string>")).alias("labels"), outcome.alias("outcome"))


def benchmark_candidates(lines: DataFrame, record: list[str], class_map: DataFrame) -> DataFrame:
    """``labels, classes, unknown_labels, part`` for each record with a line of five tokens at least.

    ``part`` is core (all classes mapped), reject (none) or mixed. Coordinates keep their text; class
    0 is reported by its name, other unmapped ones by their number.
    """
    words = tokens(F.col("line"))
    cut = lines.withColumn("_w", words).filter(F.size("_w") >= 5)
    named = cut.withColumn("_class", class_id(F.get("_w", 0), mode="truncate"))
    joined = remap(named, _named(class_map), ["_class"])
    mapped = F.col("target_class").isNotNull()
    label = F.array_join(F.concat(F.array(F.col("target_class").cast("string")), F.slice("_w", 2, 4)), " ")
    other = F.when(F.col("_class") == 0, UNNAMED).otherwise(F.concat(F.lit("class_"), F.col("_class").cast("string")))
    per = joined.groupBy(*record).agg(
        _lines(label, mapped).alias("labels"), F.array_sort(F.collect_set("target_class")).alias("classes"), _lines(other, ~mapped).alias("unknown_labels")
    )
    part = F.when(F.size("classes") == 0, "reject").when(F.size("unknown_labels") > 0, "mixed").otherwise("core")
    none = F.array().cast("array<string>")
    return per.select(*record, F.when(part == "core", F.col("labels")).otherwise(none).alias("labels"), "classes", "unknown_labels", part.alias("part"))


def converted(lines: DataFrame, record: list[str], class_map: DataFrame) -> DataFrame:
    """``line_no, target_class, text, repeats`` of each different line after remapping its class.

    Coordinates keep their text; ``repeats`` counts the equal lines that went. A line without five
    tokens or with a class outside the map is an error.
    """
    words = lines.filter("line is not null").withColumn("_w", tokens(F.col("line")))
    named = words.withColumn("_class", class_id(F.get("_w", 0), mode="digits"))
    joined = remap(named, _named(class_map), ["_class"])
    wrong = (F.size("_w") != 5) | F.col("target_class").isNull()
    target = F.when(wrong, F.raise_error(F.concat(F.lit("invalid label line: "), "line"))).otherwise(F.col("target_class"))
    text = F.array_join(F.concat(F.array(target.cast("string")), F.slice("_w", 2, 4)), " ")
    rows = joined.select(*record, "line_no", target.alias("target_class"), text.alias("text"))
    return rows.groupBy(*record, "target_class", "text").agg(F.min("line_no").alias("line_no"), (F.count(F.lit(1)) - 1).alias("repeats"))
