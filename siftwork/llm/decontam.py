"""Benchmark decontamination by canonical templates.

A text becomes a sequence of canonical tokens: words in lower case, ``<num>`` for numbers and
number words, ``<unit>`` for a unit of measure after a number, ``<name>`` for a run of
capitalised words, of two at least where it opens a sentence. Windows of ``window`` canonical tokens are
hashed, and windows of documents are joined with windows of benchmark items by their hash. The
windows that agree on one alignment of a document with an item are then checked for consistent
slots: each number, unit or name of the item must stand for one value in the document. Where it
stands for several, its own value is taken if that is among them; windows with any other are
dropped and the rest stay. So an item with other parameters is caught, and windows with mixed-up
values count for nothing. A document holds an item if consistent windows cover at least
``coverage`` of the item's tokens.

Windows that many items have would join many documents with all of them. So an item's commonest
windows are set aside, as far as they cover less than ``coverage`` of it: a document that holds
the item has another window of it, too. Pairs of a document and an item are found by the others,
and only then all windows of the pairs that were found are compared.

A bitmap of fixed size, a Bloom filter with one hash, goes out to the tasks so that windows that
no item can have don't leave them. Whatever passes it is joined exactly; the join is a plain one
and Spark picks the side to send by size.

Cases: null and empty texts have no window. An item of fewer tokens than ``window`` is one window
of its own length. One of fewer than ``LEAST_TOKENS`` is no passage that a text could hold: it
matches texts that have its tokens, with its own slots, and no others. Repeated items each match.
A text is known by its id and its hash, so windows of different texts under one id, or without
one, never add up; equal rows count once. An id is out if one of its texts holds an item; rows
without an id are judged by their own text. Without documents or items nothing is held. Columns of
the documents stay as they are where rows are dropped; names of this module's own give way to them.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_weight, checkpointed, unused

WINDOW, COVERAGE, LEAST_TOKENS = 8, 0.5, 4
BITMAP_BITS, BUCKET = 1 << 25, 1 << 15
#: Characters taken at a time, and forms of tokens that a task keeps from one such part to the next.
CHUNK_CHARS, CACHED_TOKENS = 1 << 21, 500_000
#: Units of measure and number words.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons "
    "s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years "
    "kmh mph percent dollar dollars cent cents euro euros usd eur degree degrees celsius fahrenheit watt watts volt volts".split()
)
NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?:;\n]")
PLAIN, CAPITAL, NUMBER, UNIT, STOP, NAME = range(6)
STEP = np.uint64(0x9E3779B97F4A7C15)
WINDOWS = "id string, text_hash long, n_tokens int, at int, width int, hash long, slots array<string>, kinds string"


def _hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "replace"))


class Forms(dict):
    """Token -> its place in ``codes`` (hash of its canonical form) and ``kinds``."""

    def __init__(self):
        super().__init__()
        self.codes, self.kinds = array("Q"), array("b")

    def __missing__(self, token: str) -> int:
        low = token.lower()
        if token[0].isdigit() or low in NUMBERS:
            code, kind = _hash("<num>"), NUMBER
        elif not token[0].isalpha():
            code, kind = 0, STOP
        elif low in UNITS:
            code, kind = _hash(low), UNIT
        else:
            title = token[0].isupper() and (len(token) == 1 or token[1:] == low[1:])
            code, kind = _hash(low), CAPITAL if title and len(token) > 1 else PLAIN
        self[token] = place = len(self.codes)
        self.codes.append(code)
        self.kinds.append(kind)
        return place

    def of(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The codes and kinds of ``tokens``. What was kept before goes once it is beyond the bound."""
        if len(self) >= CACHED_TOKENS:
            self.clear()
            self.codes, self.kinds = array("Q"), array("b")
        places = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return np.array(self.codes, np.uint64)[places], np.array(self.kinds, np.int8)[places]


class Canonical:
    """Canonical tokens of several texts in one row of arrays.

    ``code`` has their hashes, ``kind`` is NUMBER, UNIT or NAME for slots, ``text`` their text by
    number, ``first`` and ``last`` the raw tokens of each, ``raw`` all raw tokens.
    """

    def __init__(self, texts: list[str | None], forms: Forms):
        raw: list[str] = []
        counts = []
        for t in texts:
            found = TOKEN.findall(t) if t else []
            raw += found
            counts.append(len(found))
        n = len(raw)
        self.raw = raw
        code, kind = forms.of(raw)
        owner = np.repeat(np.arange(len(texts)), counts)
        before = np.full(n, STOP, np.int8)
        before[1:] = kind[:-1]
        opens = np.ones(n, bool)
        opens[1:] = owner[1:] != owner[:-1]
        before[opens] = STOP
        after = np.full(n, STOP, np.int8)
        after[:-1] = np.where(opens[1:], STOP, kind[1:])
        name = (kind == CAPITAL) & ((before != STOP) | (after == CAPITAL))
        unit = (kind == UNIT) & (before == NUMBER)
        kind = np.where(name, NAME, np.where(unit, UNIT, np.where(kind == NUMBER, NUMBER, np.where(kind == STOP, STOP, PLAIN))))
        code[name], code[unit] = np.uint64(_hash("<name>")), np.uint64(_hash("<unit>"))
        again = np.zeros(n, bool)
        again[1:] = name[1:] & name[:-1] & ~opens[1:]
        keep = (kind != STOP) & ~again
        self.first = np.flatnonzero(keep)
        self.code, self.kind, self.owner = code[keep], kind[keep].astype(np.int8), owner[keep]

    def hashes(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows of ``width`` tokens within one text each."""
        n = len(self.code) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.full(n, width, np.uint64)
        for k in range(width):
            h = (h ^ self.code[k : k + n]) * STEP
            h ^= h >> np.uint64(29)
        inside = self.owner[:n] == self.owner[width - 1 :]
        return np.flatnonzero(inside), h[inside]

    def slots(self, start: int, width: int) -> tuple[list[str], str]:
        """The values of the slots of a window, and a letter for each token's kind."""
        kinds, values = self.kind[start : start + width], []
        for k in np.flatnonzero(kinds != PLAIN):
            at = int(self.first[start + k])
            end = at + 1
            if kinds[k] == NAME:
                limit = int(self.first[start + k + 1]) if start + k + 1 < len(self.first) else len(self.raw)
                while end < limit and self.raw[end][0].isupper():
                    end += 1
            values.append(" ".join(self.raw[at:end]).lower())
        return values, "".join("w?nu?N"[k] for k in kinds)


def _rows(pdf: pd.DataFrame, width_of, forms: Forms, bitmap: np.ndarray | None) -> Iterator[pd.DataFrame]:
    """Window rows of the texts; with a bitmap only those whose bit is set."""
    ids, text_hashes, texts = list(pdf["id"]), list(pdf["text_hash"]), pdf["text"]
    for a, b in by_weight(texts, CHUNK_CHARS):
        c = Canonical(list(texts.iloc[a:b]), forms)
        starts_of = np.searchsorted(c.owner, np.arange(b - a))
        lengths = np.diff(np.append(starts_of, len(c.owner)))
        out = []
        for width in width_of(lengths):
            at, h = c.hashes(width)
            if bitmap is None:
                mine = np.minimum(WINDOW, lengths)[c.owner[at]] == width if len(at) else np.zeros(0, bool)
            else:
                bit = (h % np.uint64(BITMAP_BITS)).astype(np.int64)
                mine = (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                if width < LEAST_TOKENS:
                    mine &= lengths[c.owner[at]] == width
            for i, x in zip(at[mine].tolist(), h[mine].view(np.int64).tolist()):
                row = int(c.owner[i])
                values, kinds = c.slots(i, width)
                out.append((ids[a + row], text_hashes[a + row], int(lengths[row]), i - int(starts_of[row]), width, x, values, kinds))
        yield pd.DataFrame(out, columns=["id", "text_hash", "n_tokens", "at", "width", "hash", "slots", "kinds"])


def _read(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``id, text_hash, text``; the id as a string, which is exact for every type of key."""
    return rows.select(F.col(key).cast("string").alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))


def benchmark_windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """All windows of the items, with each item's number of tokens as ``n_tokens``."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forms = Forms()
        for pdf in batches:
            widths = lambda lengths: sorted({int(x) for x in np.minimum(WINDOW, lengths) if x})
            yield from _rows(pdf, widths, forms, None)

    rows = _read(items, item_id, text).mapInPandas(windows, WINDOWS)
    named = rows.withColumnsRenamed(
        {"id": "item_id", "text_hash": "item_hash", "at": "item_at", "slots": "item_slots", "kinds": "item_kinds"}
    )
    return named.dropDuplicates(["item_id", "item_hash", "item_at", "width"])


def _bitmap(spark: SparkSession, windows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """One bit for each window hash, and the widths there are. BITMAP_BITS / 8 bytes at most."""
    bit = F.pmod(F.col("hash"), F.lit(BITMAP_BITS))
    parts = (
        windows.select("width", F.floor(bit / BUCKET).alias("k"), (bit % BUCKET).alias("b"))
        .groupBy("k")
        .agg(F.expr("bitmap_construct_agg(b)").alias("bits"), F.collect_set("width").alias("widths"))
        .collect()
    )
    out, widths = np.zeros(BITMAP_BITS // 8, np.uint8), set()
    for r in parts:
        out[int(r["k"]) * BUCKET // 8 :][: BUCKET // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
        widths |= set(r["widths"])
    return out, sorted(widths)


def telling(spots: list[tuple[int, int, int]], n_tokens: int, coverage: float) -> list[int]:
    """The starts of an item's windows that find it: all but the commonest ones, as far as those
    cover less than ``coverage`` of it. ``spots`` are (items with the window, start, width)."""
    held, out = bytearray(n_tokens), []
    for _, at, width in sorted(spots, reverse=True):
        if not out:
            more = held[:]
            more[at : at + width] = b"\1" * width
            if sum(more) < coverage * n_tokens:
                held = more
                continue
        out.append(at)
    return out


def finders(windows: DataFrame, coverage: float) -> DataFrame:
    """``item_hash, item_at`` of the windows by which pairs are found."""
    shared = windows.groupBy("hash", "width").agg(F.count_distinct("item_hash").alias("shared"))
    spots = F.collect_list(F.struct("shared", "item_at", "width"))
    each = windows.join(shared, ["hash", "width"]).groupBy("item_hash", "n_tokens").agg(spots.alias("spots"))

    @F.pandas_udf("array<int>")
    def chosen(spots: pd.Series, n_tokens: pd.Series) -> pd.Series:
        rows = zip(spots, n_tokens)
        return pd.Series([telling([(x["shared"], x["item_at"], x["width"]) for x in ss], int(n), coverage) for ss, n in rows], dtype=object)

    return each.select("item_hash", F.explode(chosen("spots", "n_tokens")).alias("item_at"))


def candidates(docs: DataFrame, windows: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Windows of the documents whose bit is set, with slots."""
    spark = docs.sparkSession
    bits, widths = _bitmap(spark, windows)
    sent = spark.sparkContext.broadcast(bits)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forms = Forms()
        for pdf in batches:
            yield from _rows(pdf, lambda _: widths, forms, sent.value)

    return _read(docs, doc_id, text).mapInPandas(find, WINDOWS)


def held(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", coverage: float = COVERAGE,
) -> DataFrame:
    """``doc_id, text_hash, item_id, coverage, n_windows, exact`` for each text that holds an item.

    ``exact`` is true where all slots have the item's own values. Ids keep their types.
    """
    every_window = checkpointed(benchmark_windows(items, item_id, item_text))
    windows = checkpointed(every_window.drop("item_id").dropDuplicates(["item_hash", "item_at", "width"]))
    found = candidates(docs, windows, doc_id, text).drop("n_tokens").withColumnRenamed("id", "doc_id")
    found = checkpointed(found.dropDuplicates(["doc_id", "text_hash", "at", "width"]))
    finding = windows.join(finders(windows, coverage), ["item_hash", "item_at"])
    pairs = (
        found.join(finding, ["hash", "width"]).filter("kinds = item_kinds")
        .select(F.col("doc_id").alias("pair_id"), F.col("text_hash").alias("pair_hash"), "item_hash").distinct()
    )
    wanted = pairs.join(windows.withColumnsRenamed({"hash": "item_window", "width": "item_width"}), "item_hash")
    same = F.col("doc_id").eqNullSafe(F.col("pair_id")) & (F.col("text_hash") == F.col("pair_hash"))
    same &= (F.col("hash") == F.col("item_window")) & (F.col("width") == F.col("item_width"))
    whole = (F.col("width") >= LEAST_TOKENS) | (F.col("slots") == F.col("item_slots"))
    hits = found.join(wanted, same).filter((F.col("kinds") == F.col("item_kinds")) & whole)
    # a window's slots are few, an alignment's windows no more than its item has
    pairs = F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")).alias("pairs")
    key = ["doc_id", "text_hash", "item_hash", "n_tokens"]
    aligned = hits.groupBy(*key, (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.collect_set(F.struct("item_at", "width", pairs)).alias("found")
    )
    every = F.array_distinct(F.flatten(F.transform("found", lambda w: w["pairs"])))
    clash = lambda p: (p["i"] != p["d"]) & F.exists("every", lambda q: (q["i"] == p["i"]) & (q["d"] != p["d"]))
    sound = (
        aligned.withColumn("every", every)
        .withColumn("clashing", F.filter("every", clash))
        .withColumn("kept", F.filter("found", lambda w: ~F.arrays_overlap(w["pairs"], F.col("clashing"))))
        .filter(F.size("kept") > 0)
        .withColumn("spots", F.transform("kept", lambda w: F.struct(w["item_at"].alias("item_at"), w["width"].alias("width"))))
        .withColumn("same", F.forall("every", lambda p: p["i"] == p["d"]))
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("spots", lambda s: F.sequence(s["item_at"], s["item_at"] + s["width"] - 1)))))
    # equal spots of several alignments of one document with one item are one
    held_texts = (
        sound.groupBy(*key)
        .agg(F.array_distinct(F.flatten(F.collect_set("spots"))).alias("spots"), F.bool_and("same").alias("exact"))
        .withColumn("coverage", covered / F.col("n_tokens"))
        .filter(F.col("coverage") >= coverage)
    )
    named = held_texts.join(every_window.select("item_hash", "item_id").distinct(), "item_hash")
    return named.select(
        F.col("doc_id").cast(docs.schema[doc_id].dataType), "text_hash", F.col("item_id").cast(items.schema[item_id].dataType),
        "coverage", F.size("spots").cast("long").alias("n_windows"), "exact",
    )


def contaminated(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", coverage: float = COVERAGE,
) -> DataFrame:
    """``held`` with one row for each id and item: that of the text with the best coverage."""
    best = F.struct("coverage", "exact", "n_windows", "text_hash")
    rows = held(docs, items, doc_id, text, item_id, item_text, coverage).groupBy("doc_id", "item_id").agg(F.max(best).alias("best"))
    return rows.select("doc_id", "item_id", "best.coverage", "best.n_windows", "best.exact")


def without_benchmark(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", coverage: float = COVERAGE
) -> DataFrame:
    """The rows of ``docs`` whose id holds no item; a row without an id goes by its own text."""
    i, h = unused(docs, "held_id", "held_hash")
    found = (
        held(docs, items, doc_id, text, coverage=coverage)
        .select(F.col("doc_id").alias(i), F.when(F.col("doc_id").isNull(), F.col("text_hash")).alias(h))
        .distinct()
    )
    own = F.when(F.col(doc_id).isNull(), F.xxhash64(text))
    return docs.join(found, F.col(doc_id).eqNullSafe(F.col(i)) & own.eqNullSafe(F.col(h)), "left_anti")
