"""Ranked search over shards of dual-sorted posting lists in wavelet trees.

A document's score for an item is the sum over the item's terms of ``weight * impact``, in 64-bit
integers; an impact depends on the term's count in the document and on the document's length.

Each shard holds some thousand documents. Its posting lists, each ordered by falling impact, are
joined into one sequence of document numbers, and a wavelet tree over it halves the numbers level by
level with a stable partition. So a list is sorted twice at once: a node of the tree is a range of
documents, in which each term's postings lie together and still begin with the largest impact. The
sum of those first impacts, by weight, bounds every score below the node; at a leaf it is the score.
The search takes the nodes of the highest bounds, maps all terms' ranges into their halves by two
ranks each, and stops when no open node can beat the k-th best document found, by score and then by
document id. Every shard gives its exact top k; the merge keeps k of them for each item.

Term counts of documents are written once to the shared folder as the index of a block of items;
lengths and document frequencies are sums over all of it. Items are taken in blocks of a fixed
number, so that what goes to the tasks (terms, weights, items) is bounded whatever their number.

Cases: null texts, and texts without a term, score nothing and don't count as documents; items
without a term, or with none that a document holds, give no row. Each row of the items is ranked for
itself, repeated or null ids too; rows with one document id each take a rank, null ids come first
among equals. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir

TOP = 50
#: Documents of a shard.
SHARD = 8192
#: Items that are searched in one pass over the documents.
BLOCK = 4096
#: Nodes that are expanded in one step, those of the highest bounds.
BEAM = 64
#: Impacts are in fractions of this.
FINE = 1_000_000_000
#: Bytes that are part of a term, A-Z folded; all others separate.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, repeats included."""
    return text.encode("utf-8", "replace").translate(FOLD).split() if text else []


def weight_of(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def impacts(tf: np.ndarray, length: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Impacts of terms found ``tf`` times in documents of ``length`` terms."""
    mass = 50 + (50 * length * documents) // total
    return (FINE * tf) // (1000 * tf + 20 * mass)


@dataclass
class Tree:
    """A shard's lists: where each term's list begins, ranks and impacts by level, its documents' ids."""

    starts: np.ndarray
    zeros: np.ndarray  # by level and place: zeros before it
    impact: np.ndarray  # by level and place, a level more than bits
    ids: list  # in order


def build(ids: list, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_terms: int) -> Tree:
    """The tree over postings ``doc, term, impact``; ``doc`` are places in ``ids``, which ascend."""
    by = np.lexsort((doc, -impact, term))
    seq, imp = doc[by].astype(np.int64), impact[by]
    starts = np.searchsorted(term[by], np.arange(n_terms + 1))
    bits = max(1, (len(ids) - 1).bit_length())
    zeros = np.zeros((bits, len(seq) + 1), np.int32)
    levels = np.zeros((bits + 1, len(seq) + 1), np.int64)
    for level in range(bits):
        levels[level, :-1] = imp
        bit = (seq >> (bits - 1 - level)) & 1
        np.cumsum(bit == 0, out=zeros[level, 1:])
        halves = np.concatenate([np.flatnonzero(bit == 0), np.flatnonzero(bit)])
        seq, imp = seq[halves], imp[halves]
    levels[bits, :-1] = imp
    return Tree(starts, zeros, levels, ids)


def best(tree: Tree, terms: np.ndarray, weights: np.ndarray, top: int = TOP) -> tuple[list[tuple[int, int]], int]:
    """The ``top`` documents ``(score, place)`` of the terms, by score and then by place, and the nodes expanded."""
    bits, size = tree.zeros.shape[0], tree.zeros.shape[1] - 1
    lo, hi = tree.starts[terms], tree.starts[terms + 1]
    there = hi > lo
    lo, hi, w = lo[there], hi[there], weights[there]
    if not len(w):
        return [], 0
    bounded = lambda level, a, b: (np.where(b > a, tree.impact[level, np.minimum(a, size)], 0) * w).sum(axis=1)
    a, b = lo[None, :].astype(np.int64), hi[None, :].astype(np.int64)
    level, first = np.zeros(1, np.int64), np.zeros(1, np.int64)
    bound = bounded(level[:, None], a, b)
    score, place = np.zeros(0, np.int64), np.zeros(0, np.int64)
    expanded = 0
    while len(bound):
        if len(score) >= top:
            # a node stays if it can hold a better score, or an equal one of a smaller document
            last = np.lexsort((place, -score))[:top]
            score, place = score[last], place[last]
            stay = (bound > score[-1]) | ((bound == score[-1]) & (first < place[-1]))
            a, b, level, first, bound = a[stay], b[stay], level[stay], first[stay], bound[stay]
        if not len(bound):
            break
        chosen = np.lexsort((first, -bound))[:BEAM] if len(bound) > BEAM else np.arange(len(bound))
        rest = np.ones(len(bound), bool)
        rest[chosen] = False
        at, x, y, base = level[chosen], a[chosen], b[chosen], first[chosen]
        expanded += len(chosen)
        x0, y0, all0 = tree.zeros[at[:, None], x], tree.zeros[at[:, None], y], tree.zeros[at, -1][:, None]
        halves_a, halves_b = np.concatenate([x0, all0 + x - x0]).astype(np.int64), np.concatenate([y0, all0 + y - y0]).astype(np.int64)
        down = np.concatenate([at + 1, at + 1])
        begins = np.concatenate([base, base + (1 << (bits - 1 - at))])
        worth = bounded(down[:, None], halves_a, halves_b)
        full = worth > 0
        leaf = full & (down == bits)
        score, place = np.concatenate([score, worth[leaf]]), np.concatenate([place, begins[leaf]])
        inner = full & (down < bits)
        a, b = np.concatenate([a[rest], halves_a[inner]]), np.concatenate([b[rest], halves_b[inner]])
        level, first = np.concatenate([level[rest], down[inner]]), np.concatenate([first[rest], begins[inner]])
        bound = np.concatenate([bound[rest], worth[inner]])
    last = np.lexsort((place, -score))[:top]
    return list(zip(score[last].tolist(), place[last].tolist())), expanded


def _index(docs: DataFrame, doc_id: str, text: str, number: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, counts`` of the documents with a term; of the terms those in ``number``."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keep, n, terms, counts = [], [], [], []
                for k, t in enumerate(part.column("text").to_pylist()):
                    words = terms_of(t)
                    if not words:
                        continue
                    seen = [(number[w], c) for w, c in Counter(words).items() if w in number]
                    keep.append(k)
                    n.append(len(words))
                    terms.append([s[0] for s in seen])
                    counts.append([s[1] for s in seen])
                arrays = [part.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(counted, f"doc_id {kind}, n long, terms array<int>, counts array<int>")


def _block(docs: DataFrame, items: list[tuple], doc_id: str, text: str, top: int, folder: str, shard: int) -> DataFrame | None:
    """``place, doc_id, score`` of a block of items, by place in the block: at most ``top`` for each."""
    wanted = [sorted(set(terms_of(t))) for _, t in items]
    number = {t: k for k, t in enumerate(sorted({t for ts in wanted for t in ts}))}
    spark = docs.sparkSession
    _index(docs, doc_id, text, number).write.parquet(folder)
    index = spark.read.parquet(folder)
    size = index.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("total")).first()
    if not size["n"]:
        return None
    # one row for each term of the block
    found = {r["t"]: r["n"] for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = np.array([weight_of(size["n"], found.get(k, 0)) for k in range(len(number))], np.int64)
    asked = [np.array([number[t] for t in ts if number[t] in found], np.int64) for ts in wanted]
    documents, total, kind = size["n"], size["total"], docs.schema[doc_id].dataType.simpleString()

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def answers() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table.column("doc_id").to_pylist()
            by = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] if ids[k] is not None else 0))
            at = np.empty(len(ids), np.int64)
            at[by] = np.arange(len(ids))
            terms, counts = table.column("terms").combine_chunks(), table.column("counts").combine_chunks()
            each = np.diff(terms.offsets.to_numpy())
            term, tf = terms.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(ids)), each)
            n = table.column("n").to_numpy().astype(np.int64)
            tree = build([ids[k] for k in by], at[doc], term, impacts(tf, n[doc], documents, total), len(number))
            places, found_ids, scores = [], [], []
            for k, ts in enumerate(asked):
                for score, place in best(tree, ts, weights[ts], top)[0]:
                    places.append(k)
                    found_ids.append(tree.ids[place])
                    scores.append(score)
            return pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(found_ids, table.column("doc_id").type), pa.array(scores, pa.int64())], ["place", "doc_id", "score"])

        for batch in batches:
            while batch.num_rows:
                room = shard - sum(h.num_rows for h in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(h.num_rows for h in held) >= shard:
                    yield answers()
                    held.clear()
        if held:
            yield answers()

    dealt = index.repartition(max(1, -(-documents // shard)))
    every = dealt.mapInArrow(searched, f"place int, doc_id {kind}, score long")
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    return every.withColumn("rank", rank).filter(F.col("rank") <= top)


def ranked(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    top: int = TOP, block: int = BLOCK, shard: int = SHARD,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``top`` documents by score, then by id."""
    spark = docs.sparkSession
    kind, item_kind = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    folder, out, k = f"{shared_dir(spark).rstrip('/')}/search-{uuid.uuid4().hex}", None, 0
    rows = iter(items.select(item_id, item_text).toLocalIterator())
    while held := [(r[0], r[1]) for r in islice(rows, block)]:
        found = _block(docs, held, doc_id, text, top, f"{folder}/{k}", shard)
        k += 1
        if found is not None:
            named = spark.createDataFrame([(i, h[0]) for i, h in enumerate(held)], f"place int, item_id {item_kind}")
            part = found.join(F.broadcast(named), "place").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
            part.write.mode("append").parquet(f"{folder}/result")
            out = spark.read.parquet(f"{folder}/result")
    return out if out is not None else spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind}, score long")
