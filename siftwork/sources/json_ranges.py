"""The elements of the arrays of one large JSON object, read by ranges of bytes in many tasks.

A document ``{"a": [{...}, ...], "b": [...]}`` can't be split at line breaks. Where a range of it
begins, two things are unknown: whether that is inside a string, and how deep in brackets. Each range
is therefore summed up first for both cases, by whether it flips the one and how it moves the other; a
running sum over the ranges tells where each of them really begins. Then each task finds the objects that
begin in its range at the depth of array elements and reads on to the end of its last one.
Whether a range begins behind a backslash is seen from the bytes before it.

Of a file there is one row a range in the running sum, a few bytes for each ``RANGE`` of the file.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import qualified, system_of

#: Bytes of a range, and bytes that are read on at a time to the end of an element.
RANGE, AHEAD = 8 << 20, 1 << 16
QUOTE, BACKSLASH, COLON = 34, 92, 58
OPEN, CLOSE = (123, 91), (125, 93)


@dataclass
class Marks:
    """Places of brackets outside of strings, the depth behind each, and whether the bytes end in a string."""

    places: np.ndarray
    depth: np.ndarray
    in_string: bool
    quotes: np.ndarray


def plain_quotes(data: np.ndarray, escaped: bool) -> np.ndarray:
    """Places of the quotes that no backslash escapes; ``escaped`` if one stands before the first byte."""
    quotes = np.flatnonzero(data == QUOTE)
    slashes = data == BACKSLASH
    if not slashes.any() and not (escaped and len(data) and data[0] == QUOTE):
        return quotes
    # the length of the run of backslashes that ends before each place
    at = np.arange(len(data))
    last = np.maximum.accumulate(np.where(slashes, -1, at))
    before = np.where(quotes > 0, last[quotes - 1], -1)
    run = quotes - 1 - before
    # a run that reaches back to the first byte goes on with what stands before it
    return quotes[(run + (escaped & (before < 0))) % 2 == 0]


def marks(data: np.ndarray, in_string: bool, escaped: bool, depth: int) -> Marks:
    quotes = plain_quotes(data, escaped)
    kind = np.isin(data, OPEN).astype(np.int8) - np.isin(data, CLOSE).astype(np.int8)
    places = np.flatnonzero(kind)
    outside = (np.searchsorted(quotes, places) + in_string) % 2 == 0
    places = places[outside]
    return Marks(places, depth + np.cumsum(kind[places].astype(np.int64)), bool((len(quotes) + in_string) % 2), quotes)


def _bytes(f: fs.NativeFile, at: int, n: int) -> np.ndarray:
    return np.frombuffer(f.read_at(n, at), np.uint8)


def _escaped(f: fs.NativeFile, at: int) -> bool:
    """True if an odd run of backslashes ends before ``at``."""
    run, step = 0, 64
    while at > 0:
        begin = max(0, at - step)
        part = f.read_at(at - begin, begin)
        own = len(part) - len(part.rstrip(b"\\"))
        run += own
        if own < len(part):
            break
        at, step = begin, step * 16
    return run % 2 == 1


def _summed(uri: str, size: int, width: int):
    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path, _ = system_of(uri)
        with system.open_input_file(path) as f:
            for pdf in batches:
                rows = []
                for k in pdf["id"]:
                    data, escaped = _bytes(f, k * width, min(width, size - k * width)), _escaped(f, k * width)
                    out, inside = marks(data, False, escaped, 0), marks(data, True, escaped, 0)
                    move = [int(m.depth[-1]) if len(m.depth) else 0 for m in (out, inside)]
                    rows.append((k, int(out.in_string), *move))
                yield pd.DataFrame(rows, columns=["id", "flips", "move_out", "move_in"])

    return summed


def _key_before(data: bytes) -> str | None:
    """The key of ``... "key" : `` at the end of ``data``."""
    import json

    text = data.rstrip()
    if not text.endswith(b":"):
        return None
    text = text[:-1].rstrip()
    if not text.endswith(b'"'):
        return None
    end = len(text) - 1
    begin = end - 1
    while begin >= 0:
        if text[begin] == QUOTE and (begin - len(text[:begin].rstrip(b"\\"))) % 2 == 0:
            return json.loads(text[begin : end + 1].decode("utf-8"))
        begin -= 1
    return None


def _found(uri: str, size: int, width: int):
    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path, _ = system_of(uri)
        with system.open_input_file(path) as f:
            for pdf in batches:
                for k, in_string, depth in zip(pdf["id"], pdf["in_string"], pdf["depth"]):
                    begin, n = k * width, min(width, size - k * width)
                    data = _bytes(f, begin, n)
                    m = marks(data, bool(in_string), _escaped(f, begin), int(depth))
                    opens = np.isin(data[m.places], OPEN)
                    rows: list[tuple[int, str | None, bool, str | None]] = []
                    # containers of the document: an opening bracket that leads from depth 1 to 2
                    for p in m.places[opens & (m.depth == 2)].tolist():
                        back = min(begin + p, AHEAD)
                        rows.append((begin + p, _key_before(f.read_at(back, begin + p - back)), bool(data[p] == 91), None))
                    # elements: objects that lead from depth 2 to 3
                    firsts = m.places[opens & (m.depth == 3) & (data[m.places] == 123)]
                    ends = m.places[~opens & (m.depth == 2)]
                    whole = np.searchsorted(ends, firsts)
                    for p, e in zip(firsts.tolist(), whole.tolist()):
                        if e < len(ends):
                            text = data[p : ends[e] + 1].tobytes()
                        else:
                            text = data[p:].tobytes() + _rest(f, begin + n, size, m, int(m.depth[-1]))
                        rows.append((begin + p, None, False, text.decode("utf-8", "replace")))
                    yield pd.DataFrame(rows, columns=["at", "key", "is_array", "element"])

    return found


def _rest(f: fs.NativeFile, at: int, size: int, m: Marks, depth: int) -> bytes:
    """What follows ``at`` of an element at depth 3 that a range cuts off."""
    parts, in_string = [], m.in_string
    while at < size:
        data = _bytes(f, at, min(AHEAD, size - at))
        more = marks(data, in_string, _escaped(f, at), depth)
        end = more.places[more.depth == 2]
        if len(end):
            parts.append(data[: end[0] + 1].tobytes())
            return b"".join(parts)
        parts.append(data.tobytes())
        at, in_string, depth = at + len(data), more.in_string, int(more.depth[-1]) if len(more.depth) else depth
    raise ValueError("the JSON document ends inside an element")


def elements(spark: SparkSession, path: str, width: int = RANGE) -> DataFrame:
    """``section, at, element``: the objects in the arrays of a JSON object as text, with the key of
    their array and their place in the file. An empty file has none; brackets that don't match are an error."""
    uri = qualified(spark, path)
    system, inside, _ = system_of(uri)
    info = system.get_file_info(inside)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    size = info.size
    ranges = -(-size // width)
    tasks = max(1, min(ranges, 16 * spark.sparkContext.defaultParallelism))
    ids = spark.range(0, ranges, 1, tasks)
    sums = ids.mapInPandas(_summed(uri, size, width), "id long, flips int, move_out long, move_in long")
    before = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    in_string = F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2
    known = sums.withColumn("in_string", in_string).withColumn("move", F.when(F.col("in_string") == 1, F.col("move_in")).otherwise(F.col("move_out")))
    starts = known.withColumn("depth", F.coalesce(F.sum("move").over(before), F.lit(0)))
    # one row a range, and a check of the whole: few bytes for each
    plan = starts.select("id", "in_string", "depth", "move", "flips").orderBy("id").toPandas()
    if len(plan) and (plan["move"].sum() != 0 or plan["flips"].sum() % 2):
        raise ValueError(f"{path} isn't a whole JSON document")
    dealt = spark.createDataFrame([(int(a), int(b), int(c)) for a, b, c in zip(plan["id"], plan["in_string"], plan["depth"])], "id long, in_string int, depth long")
    rows = dealt.repartition(tasks).mapInPandas(_found(uri, size, width), "at long, key string, is_array boolean, element string")
    # the containers of the document are few: its own keys
    tops = [(r["at"], r["key"], r["is_array"]) for r in rows.filter("element is null").select("at", "key", "is_array").orderBy("at").collect()]
    ends = [t[0] for t in tops[1:]] + [size]
    section = F.lit(None).cast("string")
    for (at, key, is_array), end in zip(tops, ends):
        if is_array:
            section = F.when((F.col("at") > at) & (F.col("at") < end), F.lit(key)).otherwise(section)
    return rows.filter("element is not null").select(section.alias("section"), "at", "element").filter("section is not null")
