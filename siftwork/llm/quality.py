"""Quality rules whose failures are judged by host.

Each document has its counts and fails any of the rules of ``RULES``: it is short or repeats
itself (the base), is full of symbols, of lines that it has already had, or of words of odd
length. Failures are summed by host (the document's source) for each rule. Rule by rule a beta
prior is fitted to the hosts' rates by moments and each host's rate is shrunk towards it. A host
is rejected, with all its documents, if its shrunk rate by any rule lies more than ``DEVIATIONS``
standard deviations of that rule's prior above its mean, and is at least ``LEAST_RATE``. So the
limit follows what is usual among hosts, a host with a few bad documents isn't judged on them
alone, and hosts that are all alike are all kept. A document that fails a rule other than the
base stays if its host does.

Cases: null texts have no words and fail the base. Documents with a null source are one host.
Repeated rows each count. With one host, or hosts all alike, the prior is as strong as it can be
(``MOST_WEIGHT`` documents). An empty table gives an empty result. Texts are used whole.
Null ids keep their row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, per_row

LEAST_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
#: A host's shrunk rate that rejects it: so many deviations of the prior above its mean, and at least this.
DEVIATIONS, LEAST_RATE, LEAST_WEIGHT, MOST_WEIGHT = 1.0, 0.25, 2.0, 1e4
#: Most symbols a word, most repeated lines a line with words, and mean lengths of words.
SYMBOL_SHARE, LINE_SHARE, WORD_LENGTHS = 0.1, 0.3, (2.0, 12.0)
#: Hosts up to which verdicts are broadcast.
BROADCAST_HOSTS = 50_000
SPACES, SYMBOLS = (" ", "\t", "\n", "\v", "\f", "\r"), re.compile(r"[#*$%&|<>]")
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more, the first occurrence included."""
    grams = list(zip(*(words[k:] for k in range(window))))
    counts = Counter(grams)
    if len(counts) == len(grams):
        return 0
    total, upto = 0, 0
    for i, g in enumerate(grams):
        if counts[g] > 1:
            total += i + window - max(i, upto)
            upto = i + window
    return total


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0, 0
    # splitting bytes splits at ASCII white space only
    words = text.encode("utf-8", "replace").split()
    seen, doubled, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(" \t\v\f\r"):
            doubled += line in seen
            lines += 1
            seen.add(line)
    chars = len(text) - sum(map(text.count, SPACES))
    return len(words), chars, len(SYMBOLS.findall(text)), doubled, repeated_words(words), lines


def counts(text: str = "text") -> Column:
    """A struct column with the counts of a text column."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    return per_row(lambda texts: pd.DataFrame([measure(t) for t in texts], columns=names), SCHEMA, F.col(text))


def failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


#: Each rule with what fails it, in terms of the counts.
RULES: dict[str, Callable[[], Column]] = {
    "base": failed,
    "symbols": lambda: F.col("n_symbols") > SYMBOL_SHARE * F.col("n_words"),
    "lines": lambda: F.col("n_dup_lines") > LINE_SHARE * F.col("n_lines"),
    "lengths": lambda: ~F.col("word_chars").between(WORD_LENGTHS[0] * F.col("n_words"), WORD_LENGTHS[1] * F.col("n_words")),
}


def host_rates(judged: DataFrame, host: str, rules: list[str]) -> DataFrame:
    """``host, n, rejected`` and each rule's shrunk ``rate_<rule>``, for each host of ``judged``.

    ``judged`` has a boolean column ``failed_<rule>`` for each rule.
    """
    hosts = judged.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"failed_{r}").cast("long")).alias(f"f_{r}") for r in rules]
    )
    # one row: hosts, documents, and for each rule failures and the sum of failures^2 / n
    s = hosts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("n"), *[F.sum(f"f_{r}").alias(f"f_{r}") for r in rules],
        *[F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / F.col("n")).alias(f"s_{r}") for r in rules],
    ).first()
    rejected, rates = F.lit(False), []
    for r in rules:
        mean, weight = beta_prior(s["hosts"], s["n"] or 0, s[f"f_{r}"] or 0, s[f"s_{r}"] or 0.0)
        rate = (F.col(f"f_{r}") + mean * weight) / (F.col("n") + weight)
        rejected |= rate > limit(mean, weight)
        rates.append(rate.alias(f"rate_{r}"))
    return hosts.select("host", "n", rejected.alias("rejected"), *rates)


def beta_prior(hosts: int, n: int, failures: int, squares: float) -> tuple[float, float]:
    """Mean and weight of the beta prior, from the moments of the hosts' failure rates."""
    if not n:
        return 0.0, MOST_WEIGHT
    mean = failures / n
    within = mean * (1 - mean)
    between = (squares / n - mean * mean) - within * hosts / n
    if between <= 0 or within <= 0:
        return mean, MOST_WEIGHT
    return mean, min(MOST_WEIGHT, max(LEAST_WEIGHT, within / between - 1))


def limit(mean: float, weight: float) -> float:
    """The rate above which a rule rejects a host."""
    return max(LEAST_RATE, mean + DEVIATIONS * (mean * (1 - mean) / (weight + 1)) ** 0.5)


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``kept``, ``rules_failed`` and ``host_rate`` (by the base) for each row."""
    measured = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), counts(text).alias("c"))
    flags = measured.select("doc_id", "host", "c.*").withColumns({f"failed_{name}": rule() for name, rule in RULES.items()})
    rows = checkpointed(flags)
    rates = checkpointed(host_rates(rows, "host", list(RULES))).select(F.col("host").alias("rated"), "rejected", F.col("rate_base").alias("host_rate"))
    if rates.count() <= BROADCAST_HOSTS:
        rates = F.broadcast(rates)
    names = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"failed_{r}"), r) for r in RULES])), ",")
    return rows.join(rates, F.col("host").eqNullSafe(F.col("rated"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("failed_base").alias("base_failed"),
        (~F.col("failed_base") & ~F.col("rejected")).alias("kept"), names.alias("rules_failed"), "host_rate",
    )
