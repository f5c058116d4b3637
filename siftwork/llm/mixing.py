"""Mixing sources to target weights by Pareto order sampling.

A source's target is its weight's share of all sizes, stops at ``most`` times its own size, and
what is above is shared again by weight. A document's expected copies are its source's target
over its size, times the document's propensity if one is given. The whole part is certain; the
fraction p is the inclusion probability of one more copy. Documents of a source are ranked by
(u / (1 - u)) / (p / (1 - p)), u a hash of the id that is uniform in (0, 1), and taken from the
smallest on while they fit into what the source still needs. What is left then goes to the
untaken document whose size comes closest to it, if that brings the source nearer to its target,
and what is left after it to another in the same way, ``ROUNDS`` times.

The cut is found without gathering a source: ranks fall into ``BINS`` bins per source, sizes are
summed by bin, a running sum over the bins finds the bin of the cut, and only that bin's rows
are ranked one by one. Bins go by the rank over the odds of the source's own p, that is by u where
no propensity is given, so they fill evenly whatever p is, 0 included.

Cases: null texts have size 0 and are never taken but where their rank comes before the cut,
which adds nothing. The null source is one source, last. Ties in rank go by id, nulls first,
then by size. Repeated rows tie and are taken in turn. An empty table gives an empty result;
if all sizes are 0, so are the targets. Other columns are kept by ``mixed`` and ignored by ``mix``,
whatever their names. There is one row a source in the windows that set targets: fine to some 100,000.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, unused

WEIGHTS, MOST_COPIES, SEED = (1, 2, 3), 3, "mix-1"
BINS = 4096
ROUNDS = 3
#: Hex digits of the hash that make u.
DIGITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``source, source_size, target`` for each source of ``sized`` (columns source, size).

    Sources are stopped in the order of ``most * source_size / weight``: the first k are if the
    level that the rest would share is above the next one's limit. One row a source.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(ordered) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), place % len(weights) + 1).cast("long")
    ranked = sums.withColumn("weight", weight).withColumn("limit", (F.col("source_size") * most) / F.col("weight"))
    by_limit = Window.orderBy("limit", F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    held = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most
    left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.sum("source_size").over(whole) - held) / left
    # open sources share the level of the first of them, which is the largest
    free = ranked.withColumn("level", level).withColumn("open", F.col("limit") >= F.col("level"))
    shared = F.max(F.when(F.col("open"), F.col("level"))).over(whole)
    target = F.when(F.col("open"), shared * F.col("weight")).otherwise((F.col("source_size") * most).cast("double"))
    return free.select("source", "source_size", target.alias("target"))


def _uniform(key: Column, seed: str) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    top = F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("bigint")
    return (top + 0.5) / float(16**DIGITS)


def _by_source(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row a source."""
    right = facts.withColumnRenamed("source", "fact_source")
    return rows.join(right, F.col("source").eqNullSafe(F.col("fact_source")), "left").drop("fact_source")


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, propensity: str | None = None, seed: str = SEED,
) -> DataFrame:
    """``doc_id, text_hash, size, source_size, target, copies, taken`` for each row.

    With a column ``propensity`` (positive numbers) the inclusion probability of the last copy is
    in proportion to it within a source; the sizes taken still meet the target.
    """
    sized = checkpointed(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            F.xxhash64(text).alias("text_hash"),
            word_count(F.col(text)).alias("size"),
            (F.col(propensity).cast("double") if propensity else F.lit(1.0)).alias("a"),
            _uniform(F.col(doc_id), seed).alias("u"),
        )
    )
    usual = sized.groupBy("source").agg((F.sum(F.col("a") * F.col("size")) / F.sum("size")).alias("usual") if propensity else F.lit(1.0).alias("usual"))
    ratio = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    plan = checkpointed(
        _by_source(targets(sized.select("source", "size"), weights, most), usual)
        .withColumn("certain", F.floor(ratio))
        .withColumn("p", ratio - F.floor(ratio))
        .withColumn("need", F.col("target") - F.col("certain") * F.col("source_size"))
    )
    # open at both ends, so that odds exist
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("p") * F.coalesce(F.try_divide("a", "usual"), F.lit(1.0))))
    odds = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    typical = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("p")))
    even = F.col("q") * (typical / (1 - typical))
    ranked = _by_source(sized, plan).withColumn("q", odds).withColumn("bin", F.floor(even / (1 + even) * BINS))
    along = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        ranked.groupBy("source", "bin", "need").agg(F.sum("size").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0)))
    )
    cut = (F.col("before") <= F.col("need")) & (F.col("need") < F.col("before") + F.col("n"))
    cuts = checkpointed(bins.filter(cut).select("source", F.col("bin").alias("cut"), "before"))
    placed = _by_source(ranked, cuts)
    outside = placed.filter(~F.col("cut").eqNullSafe(F.col("bin"))).withColumn(
        "extra", F.coalesce((F.col("bin") < F.col("cut")).cast("int"), F.lit(0))
    )
    one_by_one = Window.partitionBy("source").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.filter(F.col("cut") == F.col("bin"))
    passed = F.col("before") + F.coalesce(F.sum("size").over(one_by_one), F.lit(0))
    inside = inside.withColumn("extra", (passed + F.col("size") <= F.col("need")).cast("int"))
    drawn = checkpointed(
        outside.unionByName(inside).select(
            "row", "doc_id", "text_hash", "source", "size", "source_size", "target", "certain", "need", "q", "extra"
        )
    )
    gaps = drawn.groupBy("source").agg((F.first("need") - F.sum(F.col("size") * F.col("extra"))).alias("gap"))
    free, last = drawn.filter("extra = 0 and size > 0"), None
    for _ in range(ROUNDS):
        left = free if last is None else free.join(last, "row", "left_anti")
        closest = F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "q", "doc_id", "row", "size"))
        best = checkpointed(_by_source(left, gaps).filter("size < 2 * gap").groupBy("source").agg(closest.alias("best")))
        rows = best.select(F.col("best.row").alias("row"))
        last = rows if last is None else last.unionByName(rows)
        filled = _by_source(gaps, best)
        gaps = filled.select("source", (F.col("gap") - F.coalesce("best.size", F.lit(0))).alias("gap"))
    last = last.withColumn("last", F.lit(1))
    copies = (F.col("certain") + F.col("extra") + F.coalesce("last", F.lit(0))).cast("int")
    return drawn.join(last, "row", "left").select(
        "doc_id", "text_hash", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it has copies, with ``copy`` from 1.

    Rows meet their copies by id and text hash; repeated rows of equal id and text are dealt
    the copies of all of them evenly, one more to the first by their other columns as JSON.
    """
    i, h, n, c, k = unused(docs, "mix_id", "mix_hash", "mix_rows", "mix_copies", "mix_first")
    plan = mix(docs, doc_id, text, source, **options)
    each = plan.groupBy(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).agg(
        F.count(F.lit(1)).alias(n), F.sum("copies").alias(c)
    )
    taken = checkpointed(each.filter(F.col(c) > 0))
    met = docs.join(taken, F.col(doc_id).eqNullSafe(F.col(i)) & (F.xxhash64(F.col(text)) == F.col(h)))
    single = met.filter(F.col(n) == 1).withColumn(k, F.col(c))
    if not taken.filter(F.col(n) > 1).isEmpty():
        order = Window.partitionBy(i, h).orderBy(F.to_json(F.struct(*[docs[x] for x in docs.columns])))
        share = F.floor(F.col(c) / F.col(n)) + (F.row_number().over(order) <= F.col(c) % F.col(n)).cast("int")
        single = single.unionByName(met.filter(F.col(n) > 1).withColumn(k, share).filter(F.col(k) > 0))
    (copy,) = unused(docs, "copy")
    return single.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(k).cast("int"))).alias(copy))
