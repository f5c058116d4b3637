"""COCO documents as three relations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import pixel_box
from ..operators.classify import remap
from ..operators.match import coco_labels
from .json_ranges import RANGE, elements

SECTIONS = {
    "images": "id bigint, file_name string, width int, height int",
    "annotations": "id bigint, image_id bigint, category_id bigint, bbox array<double>",
    "categories": "id bigint, name string",
}


@dataclass
class Coco:
    images: DataFrame
    annotations: DataFrame
    categories: DataFrame


def read(spark: SparkSession, path: str, width: int = RANGE) -> Coco:
    """The three relations of a document, its elements read by ranges of ``width`` bytes in many tasks."""
    every = elements(spark, path, width)
    part = lambda name: every.filter(F.col("section") == name).select(F.from_json("element", SECTIONS[name]).alias("x")).select("x.*")
    return Coco(part("images"), part("annotations"), part("categories"))


def boxes(coco: Coco, class_map: DataFrame) -> DataFrame:
    """Annotations with target class (null: unmapped) and box as shares of their image."""
    joined = coco_labels(coco.images, coco.annotations, coco.categories)
    b = [F.get("bbox", k) for k in range(4)]
    boxed = joined.withColumn("box", pixel_box(*b, F.col("width"), F.col("height")))
    mapped = class_map.select(F.col("source_class").cast("long").alias("category_id"), "target_class", "role")
    return remap(boxed, mapped, ["category_id"])


def audit(coco: Coco, found: DataFrame) -> DataFrame:
    """One row: declared, found and missing images, annotations, categories. ``found`` has paths."""
    from .files import located

    images = located(coco.images, found).agg(
        F.count(F.lit(1)).alias("declared_images"), F.count("path").alias("found_images"), F.count_if(F.col("path").isNull()).alias("missing_images")
    )
    a = coco.annotations.agg(F.count(F.lit(1)).alias("annotations"))
    c = coco.categories.agg(F.count(F.lit(1)).alias("categories"))
    # three single rows
    return images.join(a, F.lit(True)).join(c, F.lit(True))


def candidates(coco: Coco, found: DataFrame, class_map: DataFrame) -> DataFrame:
    """``id, path, classes, boxes, unknown_labels, part`` of the images that have annotations and a file.

    Boxes are clipped to the image and those without extent left out; ``part`` is core (all
    classes mapped), reject (none) or mixed. An image's annotations are few.
    """
    from .files import located

    rows = boxes(coco, class_map)
    mapped, whole = F.col("target_class").isNotNull(), F.col("box").isNotNull()
    box = F.when(mapped & whole, F.struct(F.col("id").alias("n"), F.col("target_class").alias("class_id"), "box.x", "box.y", "box.w", "box.h"))
    name = F.coalesce("category", F.concat(F.lit("class_"), F.col("category_id").cast("string")))
    per = rows.groupBy(F.col("image_id").alias("id")).agg(
        F.array_sort(F.collect_set(F.when(whole, F.col("target_class")))).alias("classes"), F.array_sort(F.collect_list(box)).alias("boxes"),
        F.array_sort(F.collect_list(F.when(~mapped, name))).alias("unknown_labels"),
    )
    images = located(coco.images.select("id", "file_name"), found).filter("path is not null")
    known, other = F.size("classes") > 0, F.size("unknown_labels") > 0
    part = F.when(known & other, "mixed").when(known, "core").when(other, "reject").otherwise("empty")
    return images.join(per, "id").select("id", "path", "classes", "boxes", "unknown_labels", part.alias("part"))


def category_counts(coco: Coco) -> DataFrame:
    return coco.annotations.groupBy("category_id").agg(F.count(F.lit(1)).alias("annotations")).join(
        coco.categories.select(F.col("id").alias("category_id"), "name"), "category_id", "left"
    )
