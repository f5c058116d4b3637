"""Toxicity by compression distance between two zstandard dictionaries.

A text becomes its lower-case words with single spaces, cut at spaces into windows of at least
``WINDOW`` bytes. ``fit`` trains two dictionaries with zstandard's trainer. The ordinary one is
trained on windows of ordinary texts. The toxic one is trained on the stretches of toxic texts
that ordinary ones hardly have: runs of at least ``GRAM`` bytes whose share of toxic texts is at
least a contrast times their share of ordinary texts, by more than chance gives (a likelihood
ratio). Stretches may be parts of words, so forms that were never seen compress too. Stretches that the trainer leaves out are put behind its own.

The toxic compressor has both dictionaries, the ordinary one has the ordinary dictionary and a
filler of the other's length, so lengths differ by what the toxic dictionary saves alone. A
window's gain is that difference. A text's rate is the sum of its gains above a floor over its
windows; a rate against a calibrated one gives the score. Contrast, floor and rate are those with
the best F1 on labelled rows that trained neither dictionary.

Cases: a null or empty text and one without words have rate 0 and score ``0.0``. If the labelled
rows hold no toxic text, every score is 0. Repeated rows each get their result; whole texts of
any length are used; ties in calibration go to the first contrast and floor and the larger rate.
A null id has no label and its row is scored like any other. An empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_row, sample_by_class

#: Bounds of the fit: labelled documents per class, windows that train the ordinary dictionary,
#: and that dictionary's bytes.
DOCS_PER_CLASS, ORDINARY_WINDOWS, ORDINARY_BYTES = 6000, 60_000, 16_384
WINDOW, GRAM = 64, 6
#: A stretch is in so many toxic texts; counts of ordinary texts are raised by so much; contrasts tried.
LEAST_DOCS, SMOOTH, CONTRASTS = 3, 0.5, (4.0, 8.0, 16.0, 32.0)
#: The least likelihood ratio (G squared, one degree of freedom): by chance about one run in two million has it.
EVIDENCE = 25.0
FLOORS = tuple(range(9))
#: The rate is over all windows plus this number.
SPARE_WINDOWS = 2
#: Every window ends with these bytes, which both dictionaries have, so that a frame never falls back to plain bytes.
END, FILL = bytes(range(1, 9)) + bytes(range(14, 30)), b"\x0b"
WORD = re.compile(r"\w+")
SCHEMA = "score double, n_windows long, n_toxic long"


@dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    floor: int
    rate: float


def windows(text: str | None) -> list[bytes]:
    """A text's words in windows of at least WINDOW bytes, the space between two in both."""
    words = WORD.findall(text.lower()) if text else []
    if not words:
        return []
    spaced, out, at = f" {' '.join(words)} ".encode("utf-8", "replace"), [], 0
    last = len(spaced) - 1
    while at < last:
        end = spaced.find(b" ", min(at + WINDOW, last))
        out.append(spaced[at : end + 1])
        at = end
    return out


class Compressors:
    """The two compressors of a model."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        # matches of GRAM bytes at least: shorter ones are in any text
        self.settings = zstandard.ZstdCompressionParameters(
            window_log=17, chain_log=15, hash_log=15, search_log=4, min_match=GRAM, target_length=32,
            strategy=zstandard.STRATEGY_LAZY2, write_checksum=False, write_content_size=False, write_dict_id=False,
        )
        self.ordinary = self._compressor(ordinary + FILL * len(toxic) + END)
        self.toxic = self._compressor(ordinary + toxic + END)

    def _compressor(self, content: bytes) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=self.settings)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=self.settings)

    def gains(self, text: str | None) -> list[int]:
        """For each window the bytes that the toxic dictionary saves."""
        return [len(self.ordinary.compress(w + END)) - len(self.toxic.compress(w + END)) for w in windows(text)]


def rate_of(gains: list[int], floor: int) -> float:
    return sum(g - floor for g in gains if g > floor) / (len(gains) + SPARE_WINDOWS)


def calibrate(rows: list[tuple[list[float], int]]) -> tuple[float, int, float]:
    """The best F1 over ``rows`` of (rate for each of FLOORS, label), with its floor and rate."""
    positives, best = sum(y for _, y in rows), (-1.0, FLOORS[0], 1.0)
    for k, floor in enumerate(FLOORS):
        ranked = sorted(((r[k], y) for r, y in rows), reverse=True)
        hit = 0
        for i, (x, y) in enumerate(ranked):
            hit += y
            after = ranked[i + 1][0] if i + 1 < len(ranked) else 0.0
            if x > 0 and after < x and (f1 := 2 * hit / (i + 1 + positives)) > best[0]:
                best = (f1, floor, (x + after) / 2)
    return best


def runs(spaced: str) -> list[tuple[int, int]]:
    """Start and end of the shortest run of at least GRAM bytes from each character on, or of all where it has fewer."""
    size = [len(c.encode("utf-8", "replace")) for c in spaced]
    out, end, held = [], 0, 0
    for start in range(len(spaced)):
        while end < len(spaced) and held < GRAM:
            held += size[end]
            end += 1
        if held < GRAM and start:
            break
        out.append((start, end))
        held -= size[start]
    return out


def stretches(word: str, telling: set[str]) -> list[str]:
    """The parts of a word, with a space at either end, that telling runs of characters cover."""
    spaced = f" {word} "
    spans: list[list[int]] = []
    for start, end in runs(spaced):
        if spaced[start:end] in telling:
            if spans and start <= spans[-1][1]:
                spans[-1][1] = end
            else:
                spans.append([start, end])
    return [spaced[start:end] for start, end in spans]


def evidence(a: Column, b: Column, toxic: int, ordinary: int) -> Column:
    """G squared of a run in ``a`` toxic and ``b`` ordinary texts, 0 where toxic ones have no more than their share."""
    share = toxic / max(1, toxic + ordinary)
    part = lambda n, p: F.when(n > 0, n * F.log(n / ((a + b) * F.lit(max(p, 1e-12))))).otherwise(0.0)
    return F.when(a > (a + b) * F.lit(share), 2 * (part(a, share) + part(b, 1 - share))).otherwise(0.0)


def trained(size: int, samples: list[bytes], segment: int = 0) -> bytes:
    """A dictionary of zstandard's trainer, or the samples themselves where they are too few for it."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=GRAM if segment else 0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def toxic_dictionary(words: list[tuple[str, int]], telling: set[str]) -> bytes:
    """Trained on the telling stretches of ``words`` (with their numbers of toxic texts)."""
    counts: Counter[bytes] = Counter()
    for word, n in words:
        for s in stretches(word, telling):
            counts[s.encode("utf-8", "replace")] += n
    often = sorted((n, s) for s, n in counts.items() if n >= LEAST_DOCS)
    size = max(256, 2 * sum(len(s) for _, s in often))
    own = trained(size, [s for n, s in often for _ in range(n)], 2 * GRAM + 4) if often else b""
    return own + b"".join(s for _, s in often if s not in own)


def texts_of(docs: DataFrame, drawn: DataFrame) -> DataFrame:
    """``drawn`` with its texts. Its ids are few whatever the tables hold: they are sent to all tasks, so that no other text is shuffled."""
    return docs.join(F.broadcast(drawn.select("id").distinct()), "id", "left_semi").join(drawn, "id")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    train: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    docs_per_class: int = DOCS_PER_CLASS,
) -> ToxicityModel | None:
    """Learn from documents whose label (0 or 1) is in ``labels``, where ``train`` holds there.

    About ``docs_per_class`` labels of each class are drawn by a hash of the id, which bounds
    what is gathered of them. Two thirds train the dictionaries and one third calibrates. None if
    no label is 1.
    """
    rows = labels.filter(train & F.col(label).isin(0, 1)).select(
        F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")
    )
    drawn, sizes = sample_by_class(rows, "id", "y", docs_per_class, "toxicity")
    if not sizes.get("1"):
        return None
    sample = texts_of(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), drawn)
    sample = sample.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(3))).persist()
    try:
        learn = sample.filter("part > 0 and text is not null").dropDuplicates(["text"]).persist()
        n = {r["y"]: r["n"] for r in learn.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        seen = F.expr("array_distinct(regexp_extract_all(lower(text), '[\\\\p{L}\\\\p{N}_]+', 0))")
        words = (
            learn.select("y", F.explode(seen).alias("w")).groupBy("w")
            .agg(F.sum("y").alias("a"), F.sum(F.lit(1) - F.col("y")).alias("b")).persist()
        )
        parts = F.pandas_udf(lambda ws: ws.map(lambda w: list({w[i:j] for i, j in runs(w)})), "array<string>")
        each = words.select("w", "a", "b", F.explode(parts(F.concat(F.lit(" "), "w", F.lit(" ")))).alias("g"))
        contrast = F.col("a") / n.get(1, 1) / ((F.col("b") + SMOOTH) / max(1, n.get(0, 0)))
        sure = evidence(F.col("a"), F.col("b"), n.get(1, 0), n.get(0, 0)) >= EVIDENCE
        telling = (
            each.groupBy("g").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
            .filter(sure).select("g", contrast.alias("c")).filter(F.col("c") >= min(CONTRASTS)).persist()
        )
        # bounded by the sample: runs of characters in several toxic texts, and the words with any
        runs_of = {r["g"]: r["c"] for r in telling.collect()}
        held = [(r["w"], r["a"]) for r in each.filter("a > 0").join(telling.select("g"), "g", "left_semi").select("w", "a").distinct().collect()]
        cut = F.pandas_udf(lambda texts: texts.map(windows), "array<binary>")
        pieces = learn.filter("y = 0").select("id", F.explode(cut("text")).alias("w"))
        whole = pieces.count()
        share = F.pmod(F.xxhash64(F.lit("window"), "id", "w"), F.lit(1 << 30)) < (1 << 30) * min(1.0, ORDINARY_WINDOWS / max(1, whole))
        usual = [bytes(r["w"]) for r in pieces.filter(share).select("w").collect()]
        # mixed, as the trainer takes a stretch of its samples at a time
        ordinary = trained(ORDINARY_BYTES, sorted(usual, key=lambda w: (crc32(w), w)))
        made = [toxic_dictionary(sorted(held), {g for g, c in runs_of.items() if c >= least}) for least in CONTRASTS]

        def rates(texts: pd.Series) -> pd.Series:
            by = [Compressors(ordinary, toxic) for toxic in made]
            return texts.map(lambda t: [rate_of(seen, f) for c in by for seen in [c.gains(t)] for f in FLOORS], na_action=None)

        check = sample.filter("part = 0").select(F.pandas_udf(rates, "array<double>")("text").alias("r"), "y")
        rows, k = [(list(r["r"]), r["y"]) for r in check.collect()], len(FLOORS)
        tried = [(*calibrate([(r[i * k : i * k + k], y) for r, y in rows]), toxic) for i, toxic in enumerate(made)]
        _, floor, rate, toxic = max(tried, key=lambda x: x[0])
        for df in (telling, words, learn):
            df.unpersist()
    finally:
        sample.unpersist()
    return ToxicityModel(ordinary, toxic, floor, rate)


def toxicity(docs: DataFrame, model: ToxicityModel | None, text: str = "text") -> Column:
    """A struct column ``score, n_windows, n_toxic``; a score of 0.5 is the calibrated rate.

    ``n_toxic`` counts the windows whose gain is above the floor.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    state: dict[str, Compressors] = {}

    def one(t: str | None) -> tuple[float, int, int]:
        m = sent.value
        if m is None:
            return 0.0, len(windows(t)), 0
        c = state.get("c") or state.setdefault("c", Compressors(m.ordinary, m.toxic))
        gains = c.gains(t)
        rate = rate_of(gains, m.floor)
        return rate / (rate + m.rate) if rate else 0.0, len(gains), sum(g > m.floor for g in gains)

    def kernel(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["score", "n_windows", "n_toxic"])

    return per_row(kernel, SCHEMA, F.col(text))


def score(docs: DataFrame, model: ToxicityModel | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` and counts for each row."""
    return docs.select(F.col(doc_id).alias("doc_id"), toxicity(docs, model, text).alias("r")).select(
        "doc_id", "r.score", (F.col("r.score") >= 0.5).cast("int").alias("predicted"), "r.n_windows", "r.n_toxic"
    )
