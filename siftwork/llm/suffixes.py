"""Removal of repeated strings: suffixes that share a long prefix, found by difference covers.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. So each place of
a text is a suffix that is sorted by its first ``length`` bytes; those with an equal neighbour repeat.

Suffixes that could be equal meet in one place first. A hash of the ``GRAM`` bytes at each place and
its minimum over a window, the leftmost of equals, depend on the window's bytes alone: strings that
are equal have equal minima at equal distances. Minima that are found at one place of the whole
corpus tell that no string around them repeats, and such suffixes leave. The others are dealt by the
minimum of all their ``length`` bytes; neighbours with one minimum travel as one piece of text, and
equal pieces as one with their number.

The suffixes of a group of pieces are sorted by a difference cover of three. Places of residue 1 and
2 are sampled. Their triples of words are sorted and named by rank, then triples of names, until a
name stands for two bytes less than ``length``. Any two residues have a shift of 0, 1 or 2 bytes that takes
both to sampled places, so the remaining suffixes are merged with the sampled ones, and with each
other, by the bytes they skip, the name of the sampled place they reach, and the bytes after it; in each
of the three merges neighbours are compared. Names cover all of the compared bytes, so the outcome
is exact: hashes only decide where suffixes meet.

A minimum under which more than ``crowd`` bytes of different pieces meet is taken apart into its single
strings instead, which are counted by Spark like any other key.

Cases: null texts are empty; texts shorter than ``length`` keep all bytes. Texts that are equal repeat
each other whole. Rows with null or repeated ids each keep their row, and texts decide. An empty
table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, new_folder, released, stored

LENGTH = 200
#: Bytes of a hash, and hashes of a window, whose minimum is taken.
GRAM, WINDOW = 32, 96
#: Bytes of the different pieces of one minimum that are sorted together. As many may be held besides,
#: and of both two thirds are sampled places, which 21 bits name.
CROWD = 1_500_000
#: Bytes of pieces of a group of minima, as expected.
GROUP = 400_000
#: Suffixes of a piece at most; longer ones are cut.
PIECE = 4096
#: Bytes of texts that are hashed at a time, and hashes of a block, which leave 16 bits for a place.
SLICE, BLOCK = 1 << 20, 1 << 16
LOW = np.uint64(BLOCK - 1)


def gram_hashes(data: np.ndarray, width: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes at each place, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    have = 1
    while have < width:
        step = min(have, width - have)
        right = h[step:]
        h = h[:-step] * np.uint64(0xBF58476D1CE4E5B9) + (right ^ (right >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(30)
        have += step
    return h


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def minima(data: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For each window its least hash, without its last 16 bits, and the leftmost place of it."""
    n = len(data) - gram - window + 2
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    step, values, places = BLOCK - window + 1, [], []
    for at in range(0, n, step):
        part = gram_hashes(data[at : at + BLOCK + gram - 1], gram)
        least = window_minima((part & ~LOW) | np.arange(len(part), dtype=np.uint64), window)
        values.append(least & ~LOW)
        places.append((least & LOW).astype(np.int64) + at)
    return np.concatenate(values), np.concatenate(places)


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and row bounds of stretches of texts; a long text is a stretch of its own."""
    texts = batch.column(column).cast(pa.large_binary())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, "right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def _rows_of(bounds: np.ndarray, n: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The row of each of ``n`` places, and whether ``span`` bytes from it lie in that row."""
    row = np.searchsorted(bounds, np.arange(n), "right") - 1
    return row, np.arange(n) + span <= bounds[row + 1]


def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc, hash, n`` of a text's windows: how many places a least hash has, by stretch of equal ones."""
    for batch in batches:
        doc = batch.column("doc").to_numpy()
        for first, data, bounds in _slices(batch, "text"):
            value, place = minima(data)
            if not len(value):
                continue
            row, inside = _rows_of(bounds, len(value), GRAM + WINDOW - 1)
            value, place, row = value[inside], place[inside], row[inside]
            if not len(value):
                continue
            new = np.r_[True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])]
            value, row = value[new], row[new]
            run = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (row[1:] != row[:-1])])
            arrays = [pa.array(doc[first + row[run]]), pa.array(value[run].view(np.int64)), pa.array(np.diff(np.r_[run, len(value)]).astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "hash", "n"])


def pieces_of(data: np.ndarray, bounds: np.ndarray, again: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """``row, first, last, minimum`` of the stretches of suffixes that may repeat: every window of
    their first ``length`` bytes has a least hash among the sorted ``again``."""
    value, _ = minima(data)
    span = length - GRAM - WINDOW + 2
    n = len(value) - span + 1
    if n <= 0 or not len(again):
        return []
    at = np.minimum(np.searchsorted(again, value), len(again) - 1)
    bad = np.r_[0, np.cumsum(again[at] != value)]
    row, inside = _rows_of(bounds, n, length)
    may = inside & (bad[span:] == bad[:-span])
    least = window_minima(value, span)
    ok = np.flatnonzero(may)
    if not len(ok):
        return []
    new = np.r_[True, (ok[1:] != ok[:-1] + 1) | (least[ok[1:]] != least[ok[:-1]]) | (row[ok[1:]] != row[ok[:-1]])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(ok)]
    out = []
    for f, l in zip(first.tolist(), last.tolist()):
        for a in range(f, l, PIECE):
            out.append((int(row[ok[f]]), int(ok[a]), int(ok[min(a + PIECE, l) - 1]) + 1, int(least[ok[f]].view(np.int64))))
    return out


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, text, at, least, body``: the pieces of each text, whose text goes with the first one."""
    for batch in batches:
        keys, lists = batch.column("key"), batch.column("again")
        for first, data, bounds in _slices(batch, "text"):
            again = np.unique(lists.slice(first, len(bounds) - 1).flatten().to_numpy().view(np.uint64))
            rows = {k: [] for k in ("key", "text", "at", "least", "body")}
            seen = -1
            for row, a, b, least in pieces_of(data, bounds, again):
                rows["key"].append(keys[first + row].as_py())
                rows["text"].append(data[bounds[row] : bounds[row + 1]].tobytes() if row != seen else None)
                rows["at"].append(a - int(bounds[row]))
                rows["least"].append(least)
                rows["body"].append(data[a : b + LENGTH - 1].tobytes())
                seen = row
            if rows["key"]:
                types = (pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types)], list(rows))


def _named(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct ones."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    names = np.empty(len(keys), np.int64)
    names[order] = np.cumsum(np.r_[0, ranked[1:] != ranked[:-1]])
    return names


def _widths(length: int) -> list[tuple[int, int, int]]:
    """The shifts of each triple of names, multiples of three, until names stand for ``length - 2`` bytes."""
    have, goal, out = 6, length - 2, []
    while have < goal:
        far = min(2 * have, goal - have)
        if far % 3:
            raise ValueError("length - 2 must be a multiple of 3")
        near = min(have, -(-far // 6) * 3)
        out.append((0, near, far))
        have += far
    return out


def repeated(pieces: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each piece which of its suffixes of at least ``length`` bytes share their first ``length``
    bytes with another suffix of any piece."""
    text = np.frombuffer(b"".join(pieces) + bytes(length + 8), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    begins = np.r_[0, np.cumsum(sizes)[:-1]]
    n = int(sizes.sum())
    offset = np.arange(n) - np.repeat(begins, sizes)
    left = np.repeat(sizes, sizes) - offset  # bytes to the end of the piece
    residue = offset % 3
    # words of six bytes at the sampled places; places elsewhere have no name
    sampled = np.flatnonzero((residue > 0) & (left >= 6))
    word = np.zeros(len(sampled), np.int64)
    for k in range(6):
        word = (word << 8) | text[sampled + k]
    name = np.zeros(n, np.int64)
    name[sampled] = _named(word)
    have = 6
    for _, near, far in _widths(length):
        sampled = sampled[left[sampled] >= have + far]
        triple = (name[sampled] << 42) | (name[sampled + near] << 21) | name[sampled + far]
        fresh = _named(triple)
        name = np.zeros(n, np.int64)
        name[sampled] = fresh
        have += far
    whole = left >= length
    found = np.zeros(n, bool)
    # residues 1 and 2 meet at once, 0 and 1 after a byte, 0 and 2 after two; each includes its own kind
    for shift, residues in ((0, (1, 2)), (1, (0, 1)), (2, (0, 2))):
        at = np.flatnonzero(whole & ((residue == residues[0]) | (residue == residues[1])))
        key = name[at + shift]
        for k in (*range(shift), *range(length - 2 + shift, length)):
            key = (key << 8) | text[at + k]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        found[at[order][np.r_[same, False] | np.r_[False, same]]] = True
    return [found[b : b + s - length + 1] for b, s in zip(begins.tolist(), sizes.tolist())]


def _runs(flags: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, flags.view(np.int8), 0]))
    return [{"a": a, "b": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


def compared(pieces: pa.Table) -> pa.Table:
    """``least, sig, runs``: stretches of repeated suffixes of pieces ``least, sig, body, n``, ``n`` the
    places they are found at. Pieces of one minimum are compared with each other; they hold at most
    ``CROWD`` bytes. Minima whose pieces are all found more than once have nothing left to tell."""
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    out: dict[str, list] = {"least": [], "sig": [], "runs": []}
    held: list[tuple[int, bytes, bytes, int]] = []
    size = 0

    def answer() -> None:
        for (least, sig, _, _), flags in zip(held, repeated([h[2] for h in held])):
            if flags.any():
                out["least"].append(least)
                out["sig"].append(sig)
                out["runs"].append(_runs(flags))

    columns = (pieces.sort_by("least").column(c).to_pylist() for c in ("least", "sig", "body", "n"))
    for _, group in groupby(zip(*columns), key=itemgetter(0)):
        own = list(group)
        if all(g[3] > 1 for g in own):
            continue
        if size >= CROWD:
            answer()
            held, size = [], 0
        held += own
        size += sum(len(g[2]) for g in own)
    if held:
        answer()
    return pa.table([pa.array(out["least"], pa.int64()), pa.array(out["sig"], pa.binary()), pa.array(out["runs"], kind)], ["least", "sig", "runs"])


def left_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, n_removed, n_spans, kept_sha256, kept`` of texts with stretches of repeated suffixes."""
    for batch in batches:
        rows = {k: [] for k in ("key", "n_removed", "n_spans", "kept_sha256", "kept")}
        runs = batch.column("runs")
        for k in range(batch.num_rows):
            data, own = np.frombuffer(batch.column("text")[k].as_buffer(), np.uint8), runs[k].values
            gone = np.zeros(len(data) + 1, np.int32)
            np.add.at(gone, own.field("a").to_numpy(), 1)
            np.add.at(gone, own.field("b").to_numpy() + (LENGTH - 1), -1)
            stay = np.cumsum(gone[:-1]) == 0
            left = data[stay].tobytes()
            rows["key"].append(batch.column("key")[k].as_py())
            rows["n_removed"].append(len(data) - len(left))
            rows["n_spans"].append(int(np.count_nonzero(np.diff(np.r_[1, stay.view(np.int8)]) == -1)))
            rows["kept_sha256"].append(hashlib.sha256(left).hexdigest())
            rows["kept"].append(left)
        types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types)], list(rows))


def _key(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def repeats(docs: DataFrame, text: str = "text", crowd: int = CROWD) -> DataFrame:
    """``key, text, runs`` of the distinct texts with repeats: ``key`` is a text's SHA-256, ``text`` its
    bytes and ``runs`` the stretches ``a <= start < b`` of its repeated suffixes."""
    if crowd > CROWD:
        raise ValueError(f"crowd is at most {CROWD}")
    spark, texts = docs.sparkSession, docs.select(F.col(text).alias("text")).filter(F.octet_length("text") >= LENGTH)
    folder = new_folder(spark, "suffixes")
    mine = F.xxhash64("text").alias("doc")
    found = stored(texts.select(mine, "text").mapInArrow(anchors, "doc long, hash long, n long"), f"{folder}/anchors")
    again = found.groupBy("hash").agg(F.sum("n").alias("n")).filter("n > 1").select("hash")
    # a text's own list is bounded by its length
    lists = found.select("doc", "hash").join(again, "hash").groupBy("doc").agg(F.collect_set("hash").alias("again"))
    wanted = texts.select(mine, _key(F.col("text")).alias("key"), "text").join(lists, "doc")
    parts = stored(wanted.select("key", "text", "again").mapInArrow(cut, "key string, text binary, at long, least long, body binary"), f"{folder}/pieces")
    discard(spark, f"{folder}/anchors")
    released(spark)
    sig, whole = F.unhex(F.sha2("body", 256)), (F.octet_length("body") - LENGTH + 1).cast("int")
    size = F.octet_length("body").cast("long").alias("size")
    bodies = stored(parts.groupBy("least", "body").agg(F.count(F.lit(1)).alias("n")).select("least", sig.alias("sig"), "body", "n", size), f"{folder}/bodies")
    crowds = stored(bodies.groupBy("least").agg(F.sum("size").alias("size")).filter(F.col("size") > crowd).select("least"), f"{folder}/crowds")
    schema = "least long, sig binary, runs array<struct<a:int,b:int>>"
    few = bodies.select("least", "sig", "body", "n").join(crowds, "least", "left_anti")
    # minima are dealt to groups of equal expected size, which Spark keeps together
    groups = max(1, (bodies.agg(F.sum("size")).first()[0] or 0) // GROUP)
    marked = few.groupBy(F.pmod(F.xxhash64("least"), F.lit(groups)).alias("g")).applyInArrow(compared, schema)
    if not crowds.isEmpty():
        many = bodies.join(crowds, "least").select("least", "sig", "body", F.explode(F.sequence(F.lit(0), whole - 1)).alias("a"))
        single = many.select("least", "sig", "a", F.substring("body", F.col("a") + 1, F.lit(LENGTH)).alias("string"))
        # written first, so that a string that many pieces have can be split in the join with it
        twice = stored(single.groupBy("string").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("string"), f"{folder}/twice")
        one = single.join(twice, "string").select("least", "sig", F.struct("a", (F.col("a") + 1).alias("b")).alias("r"))
        marked = marked.unionByName(one.groupBy("least", "sig").agg(F.collect_list("r").alias("runs")))
    # a piece that is found more than once repeats whole
    more = bodies.filter("n > 1").select("least", "sig", F.array(F.struct(F.lit(0).alias("a"), whole.alias("b"))).alias("runs"))
    marks = stored(marked.unionByName(more), f"{folder}/marks")
    discard(spark, f"{folder}/bodies", f"{folder}/crowds", f"{folder}/twice")
    released(spark)
    placed = parts.select("key", "at", "least", sig.alias("sig")).distinct().join(marks, ["least", "sig"])
    shifted = F.transform("runs", lambda r: F.struct((r["a"] + F.col("at")).alias("a"), (r["b"] + F.col("at")).alias("b")))
    runs = placed.select("key", shifted.alias("runs")).groupBy("key").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return parts.filter("text is not null").groupBy("key").agg(F.first("text").alias("text")).join(runs, "key")


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row, and ``kept``, the bytes that
    are left, where any are removed (null: the text stays as it is)."""
    found = repeats(docs, text, crowd).select("key", "text", "runs").mapInArrow(
        left_over, "key string, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), _key(whole).alias("key"), F.octet_length(whole).cast("long").alias("n_bytes"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(found, "key", "left").select(
        "doc_id", "n_bytes", none("n_removed"), none("n_spans"), F.coalesce("kept_sha256", "key").alias("kept_sha256"), "kept"
    )
