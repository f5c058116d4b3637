"""Whole scans of a source: folders of images and labels as records with their lines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import stem
from ..functions.labels import read_line
from ..operators import checks, records
from ..operators.match import pair
from . import files
from .config import SourcePolicy
from .storage import discard, shared_folder, stored

SPLITS, BENCHMARK_SPLITS = ("train", "valid", "test"), ("test", "valid", "train")
#: Unpaired names that an error lists.
LISTED = 10


def _folders(spark: SparkSession, root: str, split: str) -> tuple[str, str] | None:
    """A split's folders of images and labels; None without both, an error without one."""
    found = {part: f"{root.rstrip('/')}/{split}/{part}" for part in ("images", "labels")}
    there = {part: files.exists(spark, path) for part, path in found.items()}
    if len(set(there.values())) > 1:
        missing = next(path for part, path in found.items() if not there[part])
        raise ValueError(f"missing folder {missing}")
    return (found["images"], found["labels"]) if all(there.values()) else None


def _lines_of(spark: SparkSession, folder: str) -> DataFrame:
    return files.label_lines(spark, folder, recursive=False).withColumn("stem", stem(F.col("path")))


def _class_map(spark: SparkSession, policy: SourcePolicy) -> DataFrame:
    rows = [(c, t, "target") for c, t in policy.class_map.items()] + [(c, None, "negative") for c in policy.negative]
    rows += [(c, None, "unsupported") for c in policy.unsupported]
    return spark.createDataFrame(sorted(rows, key=lambda r: r[0]), "source_class int, target_class int, role string")


def paired_records(spark: SparkSession, policy: SourcePolicy, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """``source, source_split, image_path, label_path, labels, is_negative, drop_reason``.

    Each split has a folder ``images`` and a folder ``labels``, read without those below; a split
    with neither is left out, one with either is an error, and so are files without a partner of
    the same stem (the last image by name stands for its stem). Kept records have no drop_reason.
    """
    record, images, label_files = ["source_split", "stem"], [], []
    for split in splits:
        if (found := _folders(spark, policy.root, split)) is None:
            continue
        keyed = [F.lit(split).alias("source_split"), stem(F.col("path")).alias("stem"), "path"]
        images.append(files.images(spark, found[0], recursive=False).select(*keyed))
        label_files.append(files.label_files(spark, found[1], recursive=False).select(*keyed))
    if not images:
        raise ValueError(f"no split below {policy.root}")
    image, label = (reduce(DataFrame.unionByName, parts).groupBy(*record) for parts in (images, label_files))
    # a stem's label files are few; folders are listed once, and files are read by what was found then
    folder = shared_folder(spark, "pairs")
    both = stored(pair(image.agg(F.max("path").alias("image_path")), label.agg(F.min("path").alias("label_path"), F.collect_list("path").alias("paths")), record), folder)
    lone = both.filter("pairing <> 'paired'").orderBy("pairing", *record).limit(LISTED).collect()
    if lone:
        discard(spark, folder)
        raise ValueError(f"images and labels that don't pair: {[(r['source_split'], r['stem'], r['pairing']) for r in lone]}")
    line = files.file_lines(both.select(*record, F.explode("paths").alias("path")))
    done = records.remapped(
        line.select(*record, "line_no", "line"), record, _class_map(spark, policy), policy.preserve_empty,
        policy.reject_other_formats, policy.exclude_unsupported,
    )
    return both.join(done, record).select(
        F.lit(policy.name).alias("source"), "source_split", "image_path", "label_path", "labels", "is_negative", "drop_reason"
    )


def nested_records(spark: SparkSession, policy: SourcePolicy) -> DataFrame:
    """``source, source_split, image_path, label_path, labels, outcome`` of all images below the root.

    An image's label lies in the folder ``labels`` beside its ``images``, at the same place below it;
    see ``records.lenient`` for the outcomes, a missing label among them. Counts by outcome are the
    counters of the scan.
    """
    image = files.images(spark, policy.root).select(F.col("path").alias("image_path"))
    image = image.withColumn("label_path", files.label_path(F.col("image_path")))
    line = files.label_lines(spark, policy.root).withColumnRenamed("path", "label_path").withColumn("found", F.lit(True))
    joined = image.join(line, "label_path", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    record = ["image_path", "label_path"]
    done = records.lenient(joined, record, _class_map(spark, policy), "found")
    return done.select(F.lit(policy.name).alias("source"), files.split_of(F.col("image_path")).alias("source_split"), *record, "labels", "outcome")


def labelled_candidates(spark: SparkSession, root: str, class_map: DataFrame, splits: tuple[str, ...] = BENCHMARK_SPLITS) -> DataFrame:
    """``source_split, split_order, image_path, labels, classes, unknown_labels, part`` by label file.

    A label file without an image is left out; of several images of a stem the first by extension
    is taken. Parts core and reject make the two sets of the benchmark.
    """
    parts = []
    for k, split in enumerate(splits):
        base = f"{root.rstrip('/')}/{split}"
        if not files.exists(spark, f"{base}/labels"):
            continue
        images = files.images(spark, f"{base}/images", recursive=False).withColumn("folder", F.lit(split))
        found = files.best_of_stem(images).withColumnRenamed("path", "image_path").drop("folder")
        lines = _lines_of(spark, f"{base}/labels").join(found, "stem")
        parts.append(lines.select(F.lit(split).alias("source_split"), F.lit(k).alias("split_order"), "image_path", "line_no", "line"))
    if not parts:
        raise ValueError(f"no labels below {root}")
    return records.benchmark_candidates(reduce(DataFrame.unionByName, parts), ["source_split", "split_order", "image_path"], class_map)


def audit(spark: SparkSession, root: str, classes: int) -> DataFrame:
    """``split, images, label_files, lines, invalid_lines`` of a source of label files."""
    from ..functions.labels import parsed

    images = files.images(spark, root).groupBy(files.split_of(F.col("path")).alias("split")).agg(F.count(F.lit(1)).alias("images"))
    lines = parsed(files.label_lines(spark, root), "line", "p", classes)
    # a file that can't be read counts as an invalid line
    bad = (F.col("line").isNotNull() & F.col("p.error").isNotNull()) | ~F.col("readable")
    labels = lines.groupBy(files.split_of(F.col("path")).alias("split")).agg(
        F.count_distinct("path").alias("label_files"), F.count("line").alias("lines"), F.count_if(bad).alias("invalid_lines")
    )
    both = images.join(labels, "split", "full_outer")
    return both.select("split", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("images", "label_files", "lines", "invalid_lines")])


def audits(spark: SparkSession, specs: list[dict]) -> DataFrame:
    """One table ``source, measure, n`` for several sources, each by its format: lines or coco."""
    from . import coco

    parts = []
    for spec in specs:
        if spec["format"] == "lines":
            totals = audit(spark, spec["root"], spec["classes"]).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("images", "label_files", "lines", "invalid_lines")])
        elif spec["format"] == "coco":
            found = files.images(spark, spec["root"]).select("path")
            totals = coco.audit(coco.read(spark, spec["annotations"]), found)
        else:
            raise ValueError(f"unknown format {spec['format']}")
        every = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("bigint").alias("n")) for c in totals.columns])
        parts.append(totals.select(F.lit(spec["name"]).alias("source"), F.explode(every).alias("x")).select("source", "x.*"))
    return reduce(DataFrame.unionByName, parts)


def preflight(
    spark: SparkSession, root: str, classes: list[str], splits: tuple[str, ...] = ("train", "valid"),
    description: str = "data.yaml", known: Sequence[int] | None = None,
) -> DataFrame:
    """``split, measure, n``: what a dataset holds and what keeps it from being trained on.

    For each split its images, label files, empty label files, valid annotations and those of each
    class, and the violations: files without partner, lines by failure code, classes without an
    annotation (``absent_class_k``). A missing description or folder is a row too. ``known`` are the
    classes that lines may have, all of ``classes`` by default. Label files are read once, and all
    counts come from one pass over them.
    """
    allowed = list(known) if known is not None else list(range(len(classes)))
    found, images, lines = [], [], []
    if not files.exists(spark, f"{root.rstrip('/')}/{description}"):
        found.append(("", "missing_description", 1))
    for split in splits:
        there = {part: f"{root.rstrip('/')}/{split}/{part}" for part in ("images", "labels")}
        missing = [part for part, path in there.items() if not files.exists(spark, path)]
        found += [(split, f"missing_folder_{part}", 1) for part in missing]
        if not missing:
            images.append(files.images(spark, there["images"], recursive=False).select(F.lit(split).alias("split"), stem(F.col("path")).alias("stem")).distinct())
            lines.append(_lines_of(spark, there["labels"]).select(F.lit(split).alias("split"), "stem", "line", "readable"))
    rows = spark.createDataFrame(found, "split string, measure string, n long")
    if not lines:
        return rows
    image, line = (reduce(DataFrame.unionByName, parts) for parts in (images, lines))
    bad = checks.line_rules(allowed)
    ok = F.col("line").isNotNull() & ~reduce(lambda a, b: a | b, bad.values())
    read = read_line(line, "line", mode="digits")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    measures = {code: F.col("line").isNotNull() & rule for code, rule in bad.items()}
    measures |= {"annotations": ok, "unreadable_label_file": ~F.col("readable")} | {f"class_{k}": ok & (F.col("_class") == k) for k in range(len(classes))}
    per = read.groupBy("split", "stem").agg(count(F.col("line").isNotNull()).alias("lines"), *[count(c).alias(m) for m, c in measures.items()])
    both = image.withColumn("i", F.lit(True)).join(per.withColumn("l", F.lit(True)), ["split", "stem"], "full_outer")
    total = both.groupBy("split").agg(
        F.count("i").alias("images"), F.count("l").alias("label_files"), F.count_if(F.col("l") & (F.col("lines") == 0)).alias("empty_labels"),
        F.count_if(F.col("l").isNull()).alias("missing_label_file"), F.count_if(F.col("i").isNull()).alias("missing_image_file"),
        *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures],
    )
    names = [c for c in total.columns if c != "split"]
    absent = [F.struct(F.lit(f"absent_class_{k}").alias("measure"), (F.col(f"class_{k}") == 0).cast("long").alias("n")) for k in range(len(classes))]
    each = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("long").alias("n")) for m in names], *absent)
    counted = total.select("split", F.explode(each).alias("x")).select("split", "x.*")
    return rows.unionByName(counted)


def require_ready(found: DataFrame) -> DataFrame:
    """``found`` of ``preflight``, or an error that names its violations, of which there are few kinds."""
    held = ("images", "label_files", "empty_labels", "annotations")
    wrong = found.filter(~F.col("measure").isin(*held) & ~F.col("measure").rlike("^class_[0-9]+$") & (F.col("n") > 0)).orderBy("split", "measure").collect()
    if wrong:
        raise ValueError("not ready: " + ", ".join(f"{r['split']}:{r['measure']}={r['n']}" for r in wrong))
    return found
