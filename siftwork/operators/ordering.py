"""Positions and running sums in a global random order, without one task that sees all rows.

Rows are ordered by a hex digest. Its first digits put them into buckets of equal expected size;
sizes are summed by bucket, a running sum over the buckets (at most 16**DIGITS rows a group)
gives each bucket its offset, and rows are ordered within their bucket only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 3


def placed(df: DataFrame, digest: str, by: list[str] = (), size: str | None = None, tie: list[str] = (), digits: int = DIGITS) -> DataFrame:
    """``df`` with ``position`` (from 1) and ``before``, the sum of ``size`` over the rows ahead,
    in the order of the hex column ``digest``, then ``tie``, within each group of ``by``."""
    by = list(by)
    sized = df.withColumn("_b", F.substring(digest, 1, digits)).withColumn("_s", F.col(size) if size else F.lit(0))
    along = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    offsets = (
        sized.groupBy(*by, "_b")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("_s").alias("_t"))
        .select(*by, "_b", F.coalesce(F.sum("_n").over(along), none).alias("_rows"), F.coalesce(F.sum("_t").over(along), none).alias("_sum"))
    )
    own = Window.partitionBy(*by, "_b").orderBy(digest, *tie)
    ahead = own.rowsBetween(Window.unboundedPreceding, -1)
    inside = sized.withColumn("_k", F.row_number().over(own)).withColumn("_a", F.coalesce(F.sum("_s").over(ahead), none))
    renamed = offsets.withColumnsRenamed({c: f"_g_{c}" for c in [*by, "_b"]})
    same = F.lit(True)
    for c in [*by, "_b"]:
        same &= F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return inside.join(renamed, same, "left").select(
        *df.columns, (F.col("_k") + F.col("_rows")).alias("position"), (F.col("_a") + F.col("_sum")).alias("before")
    )
