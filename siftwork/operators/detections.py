"""Model outputs as rows. Running a model isn't part of this library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def extracted(results: DataFrame, record: list[str], boxes: str, names: dict[int, str]) -> DataFrame:
    """A row for each box of an array of structs cls, conf, xyxy: name, confidence, box to one
    decimal (half to even on the exact binary value, which the JVM's rounding of the shortest
    decimal text isn't: 0.15 and 0.35 differ), and the place of the box. Sort where they are shown."""
    table = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)])
    rounded = F.pandas_udf(lambda s: s.map(lambda b: [round(float(v), 1) for v in b], na_action="ignore"), "array<double>")
    each = results.select(*record, F.posexplode(boxes).alias("at", "b"))
    return each.select(
        *record, "at", F.try_element_at(table, F.col("b.cls")).alias("class"), F.col("b.conf").alias("confidence"), rounded("b.xyxy").alias("box")
    )


def numbered(detections: DataFrame, record: list[str], items: str) -> DataFrame:
    """Rows ``#`` (from 1), class and confidence to three decimals from an array per record."""
    each = detections.select(*record, F.posexplode(items).alias("at", "d"))
    return each.select(*record, (F.col("at") + 1).alias("number"), F.col("d.class").alias("class"), F.bround("d.confidence", 3).alias("confidence"))


def distinct_contents(frames: DataFrame, content: str) -> DataFrame:
    return frames.agg(F.count_distinct(F.sha2(F.col(content).cast("binary"), 256)).alias("contents"))
