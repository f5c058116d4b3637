"""Language identification by words, with character n-grams for the words not seen in training.

``fit`` counts words per language over a bounded sample of labelled rows, and the character
n-grams of those words. Every language with a labelled row is learned, and every word and n-gram
of at least ``LEAST_COUNT`` occurrences: rarer ones say little, and n-grams stand in for the words.
A word that the model knows scores by its log frequency in each language. For another word the
longest n-grams of which any is known score in its place: orders 5, 4, 3, 2, 1 in turn. A text's
language is the one with the largest sum over its words. The model keeps only the languages that
have a word or n-gram, so it grows with the sample, not with that times the languages.

Cases: a null text, an empty one and one without a letter give ``und`` with score 0. A text
with letters of which the model knows none (another script) goes to the most frequent language.
Without any labelled row every text gives ``und``. Ties go to the first language by code point.
Repeated rows each get their result; texts are used whole at any length. Only the key that the
sample is drawn by is read of an id, so null ids are drawn alike. An empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_row, sample_by_class

UND = "und"
#: Bound of the fit: rows sampled per language, which bounds the model. Least occurrences in them.
DOCS_PER_LANGUAGE, LEAST_COUNT, ORDERS = 3000, 3, (5, 4, 3, 2, 1)
#: A text's evidence counts as that of this many words at most, so that scores of long mixed
#: texts stay below 1.
EVIDENCE_WORDS = 20
#: Numbers kept as scores of words by each task.
CACHED_SCORES = 1_600_000
WORD = re.compile(r"[^\W\d_]+")
SCHEMA = "lang_pred string, score double"


#: For each language that has a term, its number and by how much its log frequency is above that of unseen terms.
Table = dict[str, tuple[tuple[int, float], ...]]


@dataclass
class LanguageModel:
    """Log frequencies per language of words and n-grams; languages by code point.

    ``floors`` has the log frequency of an unseen term for words (0) and for n-grams of each order.
    """

    languages: list[str]
    prior: list[float]
    floors: dict[int, list[float]]
    words: Table
    grams: Table


def _log_table(rows: list, languages: list[str]) -> tuple[list[float], Table]:
    at = {c: i for i, c in enumerate(languages)}
    totals, sums, smooth = [0] * len(languages), {}, 0.5
    for r in rows:
        sums.setdefault(r["t"], []).append((at[r["lang"]], r["n"]))
        totals[at[r["lang"]]] += r["n"]
    floor = [math.log(smooth) - math.log(n + smooth * (len(sums) + 1)) for n in totals]
    return floor, {t: tuple((i, math.log(n / smooth + 1)) for i, n in sorted(ns)) for t, ns in sums.items()}


def fit(
    docs: DataFrame,
    train: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    docs_per_language: int = DOCS_PER_LANGUAGE,
) -> LanguageModel:
    """Learn from the rows of ``docs`` where ``train`` holds and ``lang`` is not null.

    The sample of ``docs_per_language`` rows a language is drawn by a hash of the id.
    """
    rows = docs.filter(train).select(
        F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")
    )
    sample, sizes = sample_by_class(rows, "id", "lang", docs_per_language, "langid")
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], [], {}, {}, {})
    words = (
        sample.select("lang", F.explode(F.expr("regexp_extract_all(lower(text), '\\\\p{L}+', 0)")).alias("t"))
        .groupBy("lang", "t")
        .agg(F.count(F.lit(1)).alias("n"))
        .persist()
    )
    try:
        grams = (
            words.select("lang", "n", F.concat(F.lit("^"), "t", F.lit("$")).alias("w"))
            .select("lang", "n", "w", F.explode(F.array(*map(F.lit, ORDERS))).alias("o"))
            .filter(F.length("w") >= F.col("o"))
            .select(
                "lang", "n", "o",
                F.explode(F.expr("transform(sequence(1, length(w) - o + 1), i -> substring(w, i, o))")).alias("t"),
            )
            .groupBy("lang", "o", "t")
            .agg(F.sum("n").alias("n"))
        )
        often = F.col("n") >= LEAST_COUNT
        word_rows = words.filter(often).select("lang", "t", "n").collect()
        gram_rows = grams.filter(often).select("lang", "o", "t", "n").collect()
    finally:
        words.unpersist()
    floors, tables = {}, {}
    floors[0], known = _log_table(word_rows, languages)
    for order in ORDERS:
        floors[order], table = _log_table([r for r in gram_rows if r["o"] == order], languages)
        tables |= table
    whole = sum(sizes.values())
    return LanguageModel(languages, [math.log(sizes[c] / whole) for c in languages], floors, known, tables)


class Scorer:
    """Scores texts by a model; keeps the scores of words that it has met, up to a bound."""

    def __init__(self, model: LanguageModel):
        self.model, self.seen = model, {}
        self.nothing = (0.0,) * len(model.languages)
        self.most = max(1, CACHED_SCORES // max(1, len(model.languages)))

    def word(self, w: str) -> tuple[float, ...]:
        got = self.seen.get(w)
        if got is None:
            if len(self.seen) >= self.most:
                self.seen.clear()
            found = self.model.words.get(w)
            got = self.seen[w] = self._sum(0, [found]) if found else self._by_grams(w)
        return got

    def _sum(self, order: int, found: list[tuple[tuple[int, float], ...]]) -> tuple[float, ...]:
        """The mean score of known terms for each language."""
        total = list(self.model.floors[order])
        for term in found:
            for i, above in term:
                total[i] += above / len(found)
        return tuple(total)

    def _by_grams(self, w: str) -> tuple[float, ...]:
        w, known = f"^{w}$", self.model.grams
        for n in ORDERS:
            found = [g for i in range(len(w) - n + 1) if (g := known.get(w[i : i + n])) is not None]
            if found:
                return self._sum(n, found)
        return self.nothing

    def text(self, t: str | None) -> tuple[str, float]:
        words = WORD.findall(t.lower()) if t else []
        if not self.model.languages or not any(c.isalpha() for w in words for c in w):
            return UND, 0.0
        counts = Counter(words)
        table = np.array([self.word(w) for w in counts])
        n = np.fromiter(counts.values(), float, len(counts))
        total = n @ table
        if not total.any():
            total = np.array(self.model.prior)
        best = int(total.argmax())
        share = np.exp((total - total[best]) * min(1.0, EVIDENCE_WORDS / n.sum()))
        return self.model.languages[best], float(1 / share.sum())


def language(docs: DataFrame, model: LanguageModel, text: str = "text") -> Column:
    """A struct column ``lang_pred, score`` for ``docs``; the model goes out as one broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    state: dict[str, Scorer] = {}

    def kernel(texts: pd.Series) -> pd.DataFrame:
        scorer = state.get("scorer") or state.setdefault("scorer", Scorer(sent.value))
        return pd.DataFrame([scorer.text(t) for t in texts], columns=["lang_pred", "score"])

    return per_row(kernel, SCHEMA, F.col(text))


def identify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for each row."""
    return docs.select(F.col(doc_id).alias("doc_id"), language(docs, model, text).alias("r")).select(
        "doc_id", "r.lang_pred", "r.score"
    )
