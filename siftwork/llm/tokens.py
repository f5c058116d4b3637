"""Token counts of sections, from one encoding of each whole document.

A document is encoded once with a public byte-level BPE vocabulary. Its tokens' character spans
are joined with the spans of its sections (by default its lines, each with its line break), and
each section is given its tokens. A token that crosses a boundary is dealt by ``rule``: to the
section where it ``start``s, where it ``end``s, to the one with ``most`` of its characters (the
first of equals), or ``split`` in proportion to characters. Sections tile the text, so the
sections' tokens add up to the document's.

Sections may also be given by their starts, and ``field_tokens`` takes several columns as the
sections of one text, which is encoded whole: a separator between two belongs to the first of them.

Cases: a null or empty text is one empty section without tokens. A character that several tokens
share counts for each of them. Repeated rows each get their sections, null ids too. Texts are
encoded whole. An empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How a token that crosses a boundary is dealt.
RULES = ("start", "end", "most", "split")
SECTIONS = "array<struct<section:int,start:int,end:int,n_tokens:double,n_crossing:int>>"


def default_vocabulary() -> tuple[str, str]:
    """Path and splitting pattern of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


class Encoder:
    def __init__(self, ranks: bytes, pattern: str):
        pairs = (line.split() for line in ranks.splitlines() if line)
        table = {base64.b64decode(a): int(b) for a, b in pairs}
        self.lengths = np.zeros(max(table.values()) + 1, np.int64)
        for token, rank in table.items():
            self.lengths[rank] = len(token)
        self.coder = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and past-last character of each token, and the characters' line numbers' starts."""
        data = text.encode("utf-8", "replace")
        ends = np.cumsum(self.lengths[self.coder.encode_ordinary(text)])
        raw = np.frombuffer(data, np.uint8)
        opens = (raw & 0xC0) != 0x80
        char = np.cumsum(opens) - 1
        starts = np.concatenate(([0], ends[:-1]))
        lines = char[np.flatnonzero(raw == 10)] + 1
        first = np.concatenate(([0], lines[lines < char[-1] + 1]))
        return char[starts], char[ends - 1] + 1, first


def attribute(text: str | None, encoder: Encoder, rule: str, starts: np.ndarray | None = None) -> list[tuple]:
    """``(section, start, end, n_tokens, n_crossing)`` for each line of a text, or for each of the
    sections that begin at ``starts``, the first of which is 0."""
    if not text:
        return [(i, 0, 0, 0.0, 0) for i in range(1 if starts is None else len(starts))]
    begin, end, first = encoder.spans(text)
    first = first if starts is None else np.asarray(starts, np.int64)
    n, last = len(first), np.append(first[1:], len(text))
    a = np.searchsorted(first, begin, "right") - 1
    b = np.searchsorted(first, end - 1, "right") - 1
    crosses = a != b
    tokens = np.bincount(a[~crosses], minlength=n).astype(float)
    crossing = np.zeros(n, int)
    for i in np.flatnonzero(crosses):
        own = np.arange(a[i], b[i] + 1)
        share = np.minimum(last[own], end[i]) - np.maximum(first[own], begin[i])
        crossing[own] += 1
        if rule == "split":
            tokens[own] += share / share.sum()
        else:
            tokens[{"start": a[i], "end": b[i], "most": own[share.argmax()]}[rule]] += 1
    return list(zip(range(n), first.tolist(), last.tolist(), tokens.tolist(), crossing.tolist()))


def _sections(spark: SparkSession, text: Column, starts: Column, rule: str, vocabulary: str | None, pattern: str | None) -> Column:
    """The vocabulary is read on the driver and broadcast: its file has a fixed size, about 1 MB."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if vocabulary is None or pattern is None:
        found = default_vocabulary()
        vocabulary, pattern = vocabulary or found[0], pattern or found[1]
    with open(vocabulary, "rb") as f:
        sent = spark.sparkContext.broadcast((f.read(), pattern))
    state: dict[str, Encoder] = {}

    @F.pandas_udf(SECTIONS)
    def sections(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        encoder = state.get("e") or state.setdefault("e", Encoder(*sent.value))
        for texts, firsts in batches:
            yield pd.Series([attribute(t, encoder, rule, s) for t, s in zip(texts, firsts)], dtype=object)

    return sections(text, starts)


def section_tokens(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: str = "start",
    vocabulary: str | None = None, pattern: str | None = None, starts: str | None = None,
) -> DataFrame:
    """``doc_id, section, start, end, n_tokens, n_crossing``, a row for each section: for each line,
    or, with the name of a column of ascending ``starts`` (characters, the first 0), for each of those."""
    first = F.col(starts).cast("array<bigint>") if starts else F.lit(None).cast("array<bigint>")
    made = _sections(docs.sparkSession, F.col(text), first, rule, vocabulary, pattern)
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(made).alias("s")).select("doc_id", "s.*")


def field_tokens(
    docs: DataFrame, fields: list[str], doc_id: str = "doc_id", separator: str = "\n\n", rule: str = "start",
    vocabulary: str | None = None, pattern: str | None = None,
) -> DataFrame:
    """``doc_id, field, n_tokens, n_crossing``, a row for each of ``fields``; null fields are empty."""
    texts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    starts, at = [], F.lit(0)
    for t in texts:
        starts.append(at.cast("bigint"))
        at = at + F.length(t) + len(separator)
    made = _sections(docs.sparkSession, F.concat_ws(separator, *texts), F.array(*starts), rule, vocabulary, pattern)
    each = docs.select(F.col(doc_id).alias("doc_id"), F.explode(made).alias("s"))
    names = F.array(*map(F.lit, fields))
    return each.select("doc_id", F.get(names, F.col("s.section")).alias("field"), "s.n_tokens", "s.n_crossing")
