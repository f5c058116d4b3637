"""Caps, splits and balanced selections, in a seeded order that any engine can repeat.

The order is by ``sha256(seed:id)``. Running positions over all rows or families come from
``ordering.placed``, so no task has to see them all. Only single numbers come to the driver. The
splits read their families, one row each, several times: they are written once to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import seeded_order
from ..sources.storage import discard, shared_folder, stored
from .ordering import DIGITS, placed


def _fraction(fraction: float) -> float:
    if not 0 < fraction < 1:
        raise ValueError("the fraction must lie between 0 and 1")
    return float(fraction)


def cap_negatives(records: DataFrame, negative: str, key: str, fraction: float, seed: int) -> DataFrame:
    """All positives, and negatives up to ``fraction`` of the result.

    With P positives, int(fraction * P / (1 - fraction)) negatives stay, the first in seeded
    order; without positives none does. The arithmetic is that of doubles, from left to right.
    """
    if not 0 <= fraction < 1:
        raise ValueError("the fraction must be at least 0 and less than 1")
    n = records.filter(~F.col(negative)).count()
    most = int(fraction * n / (1 - fraction))
    order = records.filter(F.col(negative)).withColumn("_order", seeded_order(seed, F.col(key)))
    kept = placed(order, "_order", tie=[key]).filter(F.col("position") <= most)
    return records.filter(~F.col(negative)).unionByName(kept.drop("_order", "position", "before"))


def families_of(records: DataFrame, family: str, source: str) -> DataFrame:
    """``family, source, size`` for each family; a family of several sources has the first."""
    return records.groupBy(F.col(family).alias("family")).agg(F.min(source).alias("source"), F.count(F.lit(1)).alias("size"))


def _ordered(records: DataFrame, family: str, source: str, seed: int) -> DataFrame:
    """Families with their seeded order, written once as they are read several times."""
    fams = families_of(records, family, source).withColumn("o", seeded_order(seed, F.col("family")))
    return stored(fams, shared_folder(records.sparkSession, "families"))


def split_by_records(records: DataFrame, family: str, source: str, fraction: float, seed: int) -> DataFrame:
    """``family, source, size, split``: families go to valid until it has ``fraction`` of records.

    First one family of each source goes, if the target has room for all sources and families
    outnumber them; then families in seeded order while the target isn't met, and at least one
    family stays in train. A single family is train.
    """
    fams = _ordered(records, family, source, seed)
    n = fams.agg(F.count(F.lit(1)).alias("f"), F.count_distinct("source").alias("s"), F.sum("size").alias("r")).first()
    target = max(1, round((n["r"] or 0) * _fraction(fraction)))
    if n["f"] <= 1:
        return fams.select("family", "source", "size", F.lit("train").alias("split"))
    pre = target >= n["s"] and n["f"] > n["s"]
    first = fams.groupBy("source").agg(F.min(F.struct("o", "family")).alias("m")).select("m.family", F.lit(True).alias("pre"))
    marked = fams.join(first, "family", "left").withColumn("pre", F.coalesce("pre", F.lit(False)) & F.lit(pre))
    held = marked.filter("pre").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("base"), F.count(F.lit(1)).alias("n")).first()
    rest = placed(marked.filter("not pre"), "o", size="size", tie=["family"])
    chosen = (F.col("before") + held["base"] < target) & (F.col("position") <= n["f"] - 1 - held["n"])
    picked = rest.withColumn("valid", chosen).select("family", "source", "size", "valid")
    every = picked.unionByName(marked.filter("pre").select("family", "source", "size", F.lit(True).alias("valid")))
    return every.select("family", "source", "size", F.when(F.col("valid"), "valid").otherwise("train").alias("split"))


def split_pinned(
    records: DataFrame, family: str, keys: list[str], pinned: str, fraction: float, seed: int, valid: str = "valid", train: str = "train"
) -> DataFrame:
    """``family, cluster, split``: families that share a value of a key, in any number of steps, stay on one side.

    A cluster with a record pinned to ``valid`` is valid, any other with one pinned to ``train`` is
    train; the rest fill valid in seeded order until it has ``fraction`` of all records, and one
    cluster at least stays in train if none is pinned to it. A cluster is named by its smallest
    family. Null families are one family, null keys link nothing.
    """
    named = records.select(F.col(family).alias("family"), F.col(pinned).alias("pin"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    links = None
    for i in range(len(keys)):
        own = named.filter(F.col("family").isNotNull()).select("family", F.struct(F.lit(i).alias("i"), F.col(f"k{i}").cast("string").alias("k")).alias("key")).filter(f"k{i} is not null").distinct()
        links = own if links is None else links.unionByName(own)
    every = named.select("family").distinct()
    known = clusters(links, "family", "key").withColumnRenamed("family", "_f")
    placed_in = every.join(known, F.col("family") == F.col("_f"), "left").select("family", F.coalesce("cluster", "family").alias("cluster"))
    has = lambda side: F.coalesce(F.bool_or(F.col("pin") == side), F.lit(False))
    sizes = named.groupBy("family").agg(F.count(F.lit(1)).alias("size"), has(valid).alias("v"), has(train).alias("t")).withColumnRenamed("family", "_f")
    joined = placed_in.join(sizes, F.col("family").eqNullSafe(F.col("_f")))
    groups = joined.groupBy("cluster").agg(F.sum("size").alias("size"), F.bool_or("v").alias("v"), F.bool_or("t").alias("t"))
    groups = stored(groups.withColumn("o", seeded_order(seed, F.col("cluster"))), shared_folder(records.sparkSession, "clusters"))
    free = ~F.col("v") & ~F.col("t")
    n = groups.agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("r"), F.coalesce(F.sum(F.when(F.col("v"), F.col("size"))), F.lit(0)).alias("base"),
        F.count_if(free).alias("free"), F.count_if(F.col("t") & ~F.col("v")).alias("kept"),
    ).first()
    target = max(1, round(n["r"] * _fraction(fraction)))
    rest = placed(groups.filter(free), "o", size="size", tie=["cluster"])
    chosen = (F.col("before") + n["base"] < target) & (F.col("position") <= n["free"] - (0 if n["kept"] else 1))
    sides = rest.select("cluster", F.when(chosen, valid).otherwise(train).alias("split")).unionByName(
        groups.filter(~free).select("cluster", F.when(F.col("v"), valid).otherwise(train).alias("split"))
    )
    back = sides.withColumnRenamed("cluster", "_c")
    return placed_in.join(back, F.col("cluster").eqNullSafe(F.col("_c"))).select("family", "cluster", "split")


def clusters(links: DataFrame, node: str, key: str) -> DataFrame:
    """``node, cluster`` of the nodes of ``links`` (rows node, key): the smallest node that shared keys lead to.

    In each round a node takes the smallest cluster of its keys' nodes, and then that node's own, so
    that distances halve; rounds are written, and end when none changes. No key's nodes are gathered.
    """
    spark = links.sparkSession
    folder = shared_folder(spark, "closure")
    # keys of one node link nothing
    many = links.groupBy(F.col(key).alias("k")).agg(F.min(node).alias("a"), F.max(node).alias("b")).filter("a <> b").select("k")
    pairs = stored(links.select(F.col(node).alias("n"), F.col(key).alias("k")).join(many, "k"), f"{folder}/pairs")
    now, step = stored(pairs.groupBy("n").agg(F.min("n").alias("c")), f"{folder}/0"), 0
    while True:
        step += 1
        least = pairs.join(now, "n").groupBy("k").agg(F.min("c").alias("m"))
        near = pairs.join(least, "k").groupBy("n").agg(F.min("m").alias("m"))
        hop = now.select(F.col("n").alias("m"), F.col("c").alias("far"))
        after = stored(near.join(now, "n").join(hop, "m").select("n", F.least("m", "far").alias("c"), (F.least("m", "far") < F.col("c")).alias("moved")), f"{folder}/{step}")
        discard(spark, f"{folder}/{step - 1}")
        if after.filter("moved").isEmpty():
            return links.select(node).distinct().join(after.select(F.col("n").alias(node), F.col("c").alias("cluster")), node, "left").select(node, F.coalesce("cluster", node).alias("cluster"))
        now = after.select("n", "c")


def split_by_families(records: DataFrame, family: str, source: str, fraction: float, seed: int) -> DataFrame:
    """``family, source, size, split``: ``fraction`` of the families go to valid.

    First one family of each source that has two or more, if there is room for all of these;
    then families in seeded order, those that leave their source a train family before others.
    """
    fams = _ordered(records, family, source, seed)
    per = fams.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("o", "family")).alias("m"))
    n = per.agg(F.sum("n").alias("f"), F.sum((F.col("n") >= 2).cast("int")).alias("eligible")).first()
    count = n["f"] or 0
    if count < 2:
        return fams.select("family", "source", "size", F.lit("train").alias("split"))
    target = min(max(1, round(count * _fraction(fraction))), count - 1)
    pre = target >= n["eligible"]
    taken = n["eligible"] if pre else 0
    facts = per.select("source", "n", F.col("m.family").alias("first"))
    marked = fams.join(facts, "source").withColumn("pre", F.lit(pre) & (F.col("n") >= 2) & (F.col("family") == F.col("first")))
    own = placed(marked.filter("not pre"), "o", by=["source"], tie=["family"]).drop("before")
    room = F.col("n") - 1 - (F.lit(pre) & (F.col("n") >= 2)).cast("int")
    # the families that can go without emptying their source come first
    ranked = own.withColumn("o2", F.concat(F.when(F.col("position") <= room, "0").otherwise("f"), "o")).drop("position")
    # one digit more, as the first one only tells the two parts apart
    chosen = placed(ranked, "o2", tie=["family"], digits=DIGITS + 1).withColumn("valid", F.col("position") <= target - taken)
    every = chosen.select("family", "source", "size", "valid").unionByName(
        marked.filter("pre").select("family", "source", "size", F.lit(True).alias("valid"))
    )
    return every.select("family", "source", "size", F.when(F.col("valid"), "valid").otherwise("train").alias("split"))


def validation_plan(train: DataFrame, valid: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Train rows whose key isn't valid's, and one valid row a key, the first in ``order``."""
    from .dedup import first_of_each
    from .match import exclude_keys

    return exclude_keys(train, valid, key), first_of_each(valid, [key], [order])


def class_frequency(records: DataFrame, classes: str) -> DataFrame:
    """``class, records``: how many records have each class."""
    return records.select(F.explode(F.array_distinct(classes)).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("records"))


def primary_class(classes: Column, frequency: Column) -> Column:
    """The rarest class of an array by a map of frequencies, the smallest of equals."""
    return F.array_min(F.transform(classes, lambda c: F.struct(F.try_element_at(frequency, c).alias("n"), c.alias("c"))))["c"]


def balanced(
    records: DataFrame, key: str, classes: str, first_source: Column, target: int, seed: int,
    first_share: float, class_ids: list[int],
) -> DataFrame:
    """``target`` records with even quotas over their primary classes.

    Of a class's quota up to round(quota * first_share) come from ``first_source``, then others,
    then more of the first. What is missing is filled with the rest in seeded order.
    """
    counts = {r["class"]: r["records"] for r in class_frequency(records, classes).collect()}  # one row a class
    frequency = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, n)]) if counts else F.lit(None).cast("map<int,bigint>")
    quota = {c: target // len(class_ids) + (i < target % len(class_ids)) for i, c in enumerate(class_ids)}
    need = F.create_map(*[F.lit(x) for c, q in quota.items() for x in (c, q)])
    wish = F.create_map(*[F.lit(x) for c, q in quota.items() for x in (c, round(q * first_share))])
    marked = records.select(
        "*", primary_class(F.col(classes), frequency).alias("primary"), first_source.alias("is_first"), seeded_order(seed, F.col(key)).alias("o")
    )
    sizes = marked.groupBy("primary").agg(
        F.sum(F.col("is_first").cast("int")).alias("na"), F.sum((~F.col("is_first")).cast("int")).alias("nb")
    )
    q, w = F.coalesce(F.try_element_at(need, "primary"), F.lit(0)), F.coalesce(F.try_element_at(wish, "primary"), F.lit(0))
    a = F.least("na", w)
    b = F.least("nb", q - a)
    most = F.when(F.col("is_first"), a + F.least(F.col("na") - a, q - a - b)).otherwise(b)
    limits = sizes.withColumnRenamed("primary", "p")
    ranked = placed(marked, "o", by=["primary", "is_first"], tie=[key]).drop("before")
    picked = ranked.join(limits, F.col("primary").eqNullSafe(F.col("p"))).withColumn("picked", F.col("position") <= most.cast("long"))
    order = picked.withColumn("o2", F.concat(F.when(F.col("picked"), "0").otherwise("f"), "o")).drop("position")
    chosen = placed(order, "o2", tie=[key], digits=DIGITS + 1).filter(F.col("position") <= target)
    return chosen.select(*records.columns, "primary", "picked")


def seeded_sample(records: DataFrame, key: str, n: int, seed: int, by: list[str] = ()) -> DataFrame:
    """The first ``n`` rows of each group in seeded order."""
    order = records.withColumn("_order", seeded_order(seed, F.col(key)))
    return placed(order, "_order", by=list(by), tie=[key]).filter(F.col("position") <= n).drop("_order", "position", "before")
