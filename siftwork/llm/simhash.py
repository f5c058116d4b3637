"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, components.

A fingerprint has 64 bits. Fingerprints within ``distance`` bits are linked. They are split
into blocks; two that differ in at most ``distance`` bits agree in at least
``blocks - distance`` of them, so each fingerprint is keyed by every choice of that many blocks,
fingerprints meet under equal keys only, and their Hamming distance is then verified.

Work is on distinct fingerprints: any number of exact copies is one fingerprint. The members
that meet under a key are verified against each other in one numpy step, which returns the links
of a spanning forest, never all pairs. Where more than ``crowd`` fingerprints meet under a key
they aren't gathered. They are joined on midpoints: two words differ in at most 2r bits if and
only if some word differs from each in at most r, so every such member is keyed by all words in
its ball of radius ``distance / 2`` and linked to the smallest member under each. That gives the
same components and grows in proportion to the members.

Components come from alternating large-star and small-star rounds over the links. What is linked
are keys, not fingerprints: a fingerprint's key is that of its first document, so the smallest key
of a component already names it, and no step gathers a component.

Cases: null, empty and wordless texts have fingerprint zero and are linked like any other. Rows
with a null id belong to their component but name it only if no row of it has an id (the
component id is then null). Repeated rows and ids each keep their row. An empty table gives an
empty result. Other columns are kept by ``one_of_each``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, per_row, unused

BITS, SEED, SHINGLE, DISTANCE = 64, 42, 4, 4
#: Fingerprints that are verified against each other in one step; beyond it midpoints are used.
CROWD = 1024
#: Shingles hashed and counted at a time.
CHUNK = 1 << 14
UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint_of(text: str | None, width: int = SHINGLE) -> int:
    """The SimHash of a text's lower-case word shingles, repeats included; 0 without words."""
    words = text.encode("utf-8", "replace").translate(UPPER).split() if text else []
    if not words:
        return 0
    n, over = max(1, len(words) - width + 1), np.zeros(BITS, np.int64)
    spaced, digest = b" ".join(words), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[:n], ends[min(width, len(words)) - 1 :]
    for at in range(0, n, CHUNK):
        spans = zip(first[at : at + CHUNK].tolist(), last[at : at + CHUNK].tolist())
        hashes = np.array([digest(spaced[a:b], SEED) for a, b in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little")
        over += bits.reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * over > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str = "text", width: int = SHINGLE) -> Column:
    """A struct column with the fingerprint of a text column as the bigint ``fp``."""

    def kernel(texts: pd.Series) -> pd.DataFrame:
        prints = np.fromiter((fingerprint_of(t, width) for t in texts), np.uint64, len(texts))
        return pd.DataFrame({"fp": prints.view(np.int64)})

    return per_row(kernel, "fp long", F.col(text))


def hex16(fp: Column) -> Column:
    """16 lower-case hex digits of a bigint."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def block_masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """A mask for each choice of ``blocks - distance`` of ``blocks`` nearly equal bit ranges."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def ball_masks(radius: int) -> list[int]:
    """Every word with at most ``radius`` bits set."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(BITS), r)]


def _signed(word: int) -> int:
    return word - (1 << BITS) if word >> (BITS - 1) else word


def blocks_for(prints: int, distance: int = DISTANCE) -> int:
    """The least number of blocks for which evenly spread fingerprints seldom meet under a key."""
    blocks = distance + 2
    while blocks < 2 * distance + 4 and prints >> (BITS * (blocks - distance) // blocks):
        blocks += 1
    return blocks


def forest(words: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links, as places in ``words``, of a spanning forest of them within ``distance`` bits."""
    plain, left, out = words.view(np.uint64), np.ones(len(words), bool), []
    for root in range(len(words)):
        if not left[root]:
            continue
        left[root] = False
        frontier = [root]
        while frontier:
            at = frontier.pop()
            near = np.flatnonzero(left & (np.bitwise_count(plain ^ plain[at]) <= distance))
            left[near] = False
            out += [(at, int(k)) for k in near]
            frontier += near.tolist()
    return out


def links(prints: DataFrame, count: int, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """``src < dst`` such that the components of these links are those of all pairs within
    ``distance`` bits. ``prints`` has a bigint column ``fp`` without repeats, a column ``key``
    of distinct comparable values that stand for them (without it they do), and ``count`` rows.
    """
    prints = prints if "key" in prints.columns else prints.withColumn("key", F.col("fp"))
    masks = [_signed(m) for m in block_masks(blocks_for(count, distance), distance)]
    choices = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for k, m in enumerate(masks)])
    keyed = prints.select("fp", "key", F.explode(choices).alias("b")).select("b.k", "b.v", "fp", "key")
    met = checkpointed(keyed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))

    @F.pandas_udf("array<struct<i:int,j:int>>")
    def joined(groups: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in groups:
            yield batch.map(lambda g: [{"i": i, "j": j} for i, j in forest(np.asarray(g, np.int64), distance)])

    few = keyed.join(met.filter(F.col("n") <= crowd).select("k", "v"), ["k", "v"])
    groups = few.groupBy("k", "v").agg(F.collect_list(F.struct("fp", "key")).alias("g"))
    pairs = groups.select("g", F.explode(joined(F.transform("g", lambda x: x["fp"]))).alias("e"))
    ends = [F.get("g", F.col(f"e.{side}"))["key"] for side in "ij"]
    found = pairs.select(F.least(*ends).alias("src"), F.greatest(*ends).alias("dst"))
    many = met.filter(F.col("n") > crowd)
    if not many.isEmpty():
        crowded = keyed.join(many.select("k", "v"), ["k", "v"], "left_semi").select("fp", "key").distinct()
        ball = F.array(*[F.lit(_signed(m)) for m in ball_masks(distance // 2)])
        points = crowded.select("fp", "key", F.explode(ball).alias("m")).select(F.expr("fp ^ m").alias("p"), "key")
        least = points.groupBy("p").agg(F.min("key").alias("src"), F.max("key").alias("far")).filter("src < far")
        met_there = points.join(least.select("p", "src"), "p").filter("src < key")
        found = found.unionByName(met_there.select("src", F.col("key").alias("dst")))
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of the links ``src < dst``: the smallest node reachable.

    Rounds of large-star (each node links its larger neighbours to its smallest one) and
    small-star (each node links its smaller neighbours and itself to the smallest); each round
    is checkpointed. Only counts come to the driver.
    """
    stars = checkpointed(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    while True:
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            stars.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        # written first, so that both sides of the join are shuffled for it and a hub's rows can be split
        low = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pulled = large.join(low, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = checkpointed(low.withColumnRenamed("m", "b").unionByName(pulled).distinct())
        n = stars.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("a").alias("d")).first()
        if n["n"] == n["d"] and stars.join(stars.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            break
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _digest(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    return checkpointed(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), fingerprint(text, width).alias("p")
        ).select("doc_id", "text_hash", F.col("p.fp").alias("fp"))
    )


def _labelled(prints: DataFrame, distance: int, crowd: int) -> DataFrame:
    """``prints`` (columns fp and key, one row for each fingerprint) with its component's smallest key."""
    prints = checkpointed(prints)
    roots = components(links(prints, prints.count(), distance, crowd)).withColumnRenamed("node", "key")
    return prints.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    width: int = SHINGLE, distance: int = DISTANCE, crowd: int = CROWD,
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row."""
    rows = _digest(docs, doc_id, text, width)
    key = F.struct(F.col("first").isNull().alias("none"), F.col("first").alias("id"), "fp")
    known = _labelled(rows.groupBy("fp").agg(F.min("doc_id").alias("first")).select("fp", key.alias("key")), distance, crowd)
    named = known.select("fp", F.col("root.id").alias("component_id"))
    return rows.join(named, "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    width: int = SHINGLE, distance: int = DISTANCE, crowd: int = CROWD,
) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, the one with the smallest id.

    A component without ids keeps the row with the smallest text hash. Of repeated rows one stays.
    """
    rows = _digest(docs, doc_id, text, width)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    firsts = _labelled(rows.groupBy("fp").agg(F.min(key).alias("key")), distance, crowd).filter("key = root").select(F.col("key").alias("first"))
    repeats = rows.groupBy("doc_id", "text_hash").count().filter("count > 1").select("doc_id", "text_hash", F.lit(True).alias("repeated"))
    i, h, r = unused(docs, "keep_id", "keep_hash", "keep_repeated")
    stay = checkpointed(
        firsts.select(F.col("first.doc_id").alias(i), F.col("first.text_hash").alias(h))
        .join(repeats, F.col(i).eqNullSafe(repeats["doc_id"]) & (F.col(h) == repeats["text_hash"]), "left")
        .select(i, h, F.coalesce("repeated", F.lit(False)).alias(r))
    )
    met = docs.join(stay, F.col(doc_id).eqNullSafe(F.col(i)) & (F.xxhash64(F.col(text)) == F.col(h)))
    if stay.filter(F.col(r)).isEmpty():
        return met.select(*[docs[c] for c in docs.columns])
    once = met.filter(~F.col(r)).unionByName(met.filter(F.col(r)).dropDuplicates([i, h]))
    return once.select(*docs.columns)
