"""Compressed vectors: a codebook for each part of a vector, refined in rounds of exact integers.

A vector's components become ``floor(scale * x)`` and it is cut into equal consecutive parts. Each
part's codebook starts as that part of the vectors with the smallest ids; a round assigns every
part to its nearest entry and moves each entry to the floor of its parts' mean.

Nearest entries are found by segment means. A part is cut into blocks, first one, then two, then
four (where its length allows). With block sums s and residuals r about the block means,
``|x - c|^2 = sum (sx - sc)^2 / b + |rx - rc|^2``, and the last term is at least
``(|rx| - |rc|)^2``: a lower bound from a few numbers an entry. Entries whose bound exceeds an exact
distance already known leave; the blocks get finer, and what survives gets its exact integer
distance. Bounds are computed in doubles and lowered by more than their rounding error, so no
nearest entry is ever lost, and equal distances go to the lower index.

Parts are assigned in the tasks that hold them, sums and counts of a task's parts are merged by
entry, and at most ``parts * entries`` rows come to the driver in a round.

Cases: rows whose vector is null or holds null or non-finite components are left out. The length
of the kept vector with the smallest id is the table's; vectors of another length stay, with
null code and error, and train nothing. A length that ``parts`` doesn't divide is an error, and
so are components beyond 2^26 after scaling, whose distances don't fit 64 bits. Null ids come last in the order
of ids and keep their row; rows of one id are ordered by their vector; repeated rows all count.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Components whose squared distances surely fit 64 bits.
LARGEST = 1 << 26
#: Parts that are held against a codebook at a time.
STEP = 2048
#: Sums by label are broadcast up to so many labels.
BROADCAST_LABELS = 100_000


def _segments(x: np.ndarray, blocks: int) -> np.ndarray:
    """For each row its block sums over the root of a block's length, and the norm of what they leave."""
    cut = x.reshape(len(x), blocks, -1).astype(np.float64)
    width = cut.shape[2]
    sums = cut.sum(axis=2)
    rest = np.sqrt(np.square(cut - sums[:, :, None] / width).sum(axis=(1, 2)))
    return np.concatenate([sums / np.sqrt(width), rest[:, None]], axis=1)


def _levels(width: int) -> list[int]:
    return [b for b in (1, 2, 4) if width % b == 0] or [1]


def _gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The index of each row's nearest entry, its squared distance, and how many exact distances it took."""
    n, k = len(x), len(book)
    index, best, exact = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    levels = _levels(x.shape[1])
    entries = [_segments(book, b) for b in levels]
    # beyond the rounding of sums of squares of components up to LARGEST
    largest = max(float(np.abs(x).max(initial=0)), float(np.abs(book).max(initial=0)), 1.0)
    slack = 1.0 + largest * largest * x.shape[1] * 1e-12
    for at in range(0, n, STEP):
        rows = x[at : at + STEP]
        m = len(rows)
        distance = lambda i, j: np.square(rows[i] - book[j]).sum(axis=1)
        every = np.arange(m)
        means = [_segments(rows, b) for b in levels]
        # the coarsest level for all entries at once
        low = sum(np.square(means[0][:, c, None] - entries[0][None, :, c]) for c in range(means[0].shape[1])) * (1 - 1e-9) - slack
        known = distance(every, low.argmin(axis=1))
        exact += m
        i, j = np.nonzero(low <= known[:, None])
        for level in range(1, len(levels)):
            bound = _gap(means[level][i], entries[level][j]) * (1 - 1e-9) - slack
            first = np.lexsort((bound, i))
            heads = first[np.r_[True, i[first][1:] != i[first][:-1]]]
            known[i[heads]] = np.minimum(known[i[heads]], distance(i[heads], j[heads]))
            exact += len(heads)
            stay = bound <= known[i]
            i, j = i[stay], j[stay]
        d = distance(i, j)
        exact += len(d)
        order = np.lexsort((j, d, i))
        heads = order[np.r_[True, i[order][1:] != i[order][:-1]]]
        index[at : at + m], best[at : at + m] = j[heads], d[heads]
    return index, best, exact


def _vectors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _moved(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round."""
    width, parts = books[0].shape[1], len(books)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            x = _vectors(batch, width * parts)
            for p, book in enumerate(books):
                part = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
                to, _, _ = nearest(part, book)
                np.add.at(sums[p], to, part)
                counts[p] += np.bincount(to, minlength=len(book))
        for p in range(parts):
            used = np.flatnonzero(counts[p])
            arrays = [pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(counts[p][used]), pa.array(list(sums[p][used]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "entry", "n", "s"])

    partial = rows.select("x").mapInArrow(assigned, "part int, entry int, n long, s array<bigint>")
    total = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", k)) for k in range(width)]).alias("s"))
    moved = [b.copy() for b in books]
    for r in total.collect():  # at most parts * entries rows
        moved[r["part"]][r["entry"]] = np.array(r["s"], np.int64) // r["n"]
    return moved


def kept(vectors: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """``vec_id, label, x`` of the rows with a finite vector, as integers."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale))))
    return vectors.filter(x.isNotNull() & finite).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), whole.alias("x"))


def digest(books: list[np.ndarray]) -> str:
    """The SHA-256 of all entries' components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook for each part, from rows of ``kept``; none where there is no row."""
    # the first rows by id: a bounded number
    first = [r["x"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()]
    if not first or not first[0]:
        return []
    dim = len(first[0])
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    same = rows.filter(F.size("x") == dim)
    if len({len(x) for x in first}) > 1:
        first = [r["x"] for r in same.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()]
    if not same.filter(F.exists("x", lambda v: F.abs(v) > LARGEST)).isEmpty():
        raise ValueError(f"a scaled component lies beyond {LARGEST}")
    start, width = np.array(first, np.int64), dim // parts
    books = [np.ascontiguousarray(start[:, p * width : (p + 1) * width]) for p in range(parts)]
    for _ in range(rounds):
        books = _moved(same, books)
    return books


def encoder(books: list[np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` that gives rows of ``kept`` their ``code`` and ``error``."""
    width, parts = books[0].shape[1], len(books)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch, width * parts)
            found = [nearest(np.ascontiguousarray(x[:, p * width : (p + 1) * width]), b)[:2] for p, b in enumerate(books)]
            # two digits for up to 256 entries
            digits = max(2, (max(map(len, books)) - 1).bit_length() + 3 >> 2)
            codes = ["".join(f"{int(v):0{digits}x}" for v in row) for row in np.stack([f[0] for f in found], axis=1)]
            error = np.sum([f[1] for f in found], axis=0)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return encoded


def compress(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for each row with a finite vector."""
    rows = checkpointed(kept(vectors, vec_id, vector, label, scale))
    books = fit(rows, parts, entries, rounds)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    dim = books[0].shape[1] * parts if books else -1
    other = rows.filter(F.size("x") != dim).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = other
    if books:
        schema = f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"
        coded = rows.filter(F.size("x") == dim).mapInArrow(encoder(books), schema).unionByName(other)
    coded = checkpointed(coded)
    sums = checkpointed(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    few = sums.count() <= BROADCAST_LABELS
    joined = coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("of")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
