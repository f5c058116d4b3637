"""Personal data in document texts, with DataFrame functions only.

Each kind has a regular expression that proposes spans, leftmost and non-overlapping within the
kind, a check that confirms them (Luhn, mod-97, number of digits, ranges), and words that raise
its score where they stand within ``CONTEXT`` characters. A proposal that fails its check is
dropped and not tried again. Kinds of the base are kept whatever their score; the others need
``least_score``.

The expressions are written with possessive quantifiers and look-behinds that change no match
but keep matching linear in long runs. Positions are code points, ends exclusive: a text is
split at the matches, and running sums of the lengths of pieces and matches give their places.
The sums go in two steps, over chunks and within them, since an array can't grow in place. Context
is read for confirmed proposals only.

Cases: a null text is empty and has no span. Repeated rows each get their result. Whole texts
are scanned at any length. Spans of different kinds may overlap; ``redact`` masks their union
under the kind of the first. Null ids keep their row, an empty table gives an empty result, and
other columns pass ``redact`` unchanged and are ignored by ``detect``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

CONTEXT, LEAST_SCORE = 40, 0.6
#: Values that a running sum takes at a time, and masks that are cut from one part of a text.
CHUNK = 256
SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint,value:string,score:double>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c: c.try_cast("int"))
    doubled = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97(account: Column) -> Column:
    """True if an account number, first four characters moved to its end, leaves 1 by mod 97."""
    moved = F.concat(F.substr(account, F.lit(5)), F.substring(account, 1, 4))

    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, (a * 10 + code - 48) % 97).otherwise((a * 100 + code - 55) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


@dataclass(frozen=True)
class Kind:
    """``quick`` is true for every text that ``pattern`` can match; ``score`` is without context."""

    name: str
    pattern: str
    quick: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    words: str
    score: float
    base: bool = True


def _between(n: Column, low: int, high: int) -> Column:
    return (n >= low) & (n <= high)


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
KINDS = (
    Kind(
        "email",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda t: t.contains("@"), lambda v: F.lit(True), "mail|contact|write|reach", 0.8,
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda v: v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), "ip|host|server|address|login", 0.7,
    ),
    Kind(
        "card",
        # shorter runs never pass, and none of their ends would
        r"[0-9](?:[\x20-]?[0-9]){11,}+",
        lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), lambda v: _between(F.length(_digits(v)), 12, 19) & luhn(_digits(v)), "card|visa|master|amex|credit|debit|pay", 0.7,
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda t: t.contains("+"), lambda v: _between(F.length(_digits(v)), 9, 15), "phone|call|tel|mobile|fax|reach", 0.7,
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"), lambda v: mod97(F.regexp_replace(v, " ", "")), "iban|account|bank|transfer|konto", 0.8, False,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        lambda t: t.rlike(r"[0-9]-[0-9]{2}-"), lambda v: ~v.rlike(r"^(?:000|666|9..)|-00-|-0000$"), "ssn|social|security|insurance", 0.4, False,
    ),
)


def running(values: Column, step: Callable[[Column, Column], Column], start: Column) -> Column:
    """For each of an array of bigints what ``step`` makes of all before it, from ``start`` on.

    ``step`` is associative. Each chunk of CHUNK values is folded, then the chunks' results, so
    work grows with the values as long as these are fewer than CHUNK squared, and little faster beyond.
    """

    def before(array: Column, first: Column) -> Column:
        """Grows by one value at a time, so for short arrays only; the last value is the result of all."""
        return F.aggregate(array, F.array(first), lambda a, v: F.concat(a, F.array(step(F.element_at(a, -1), v))))

    def of(v: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda c: F.slice(v, c * CHUNK + 1, F.lit(CHUNK)))
        bases = F.transform(F.array(chunks), lambda cs: before(F.transform(cs, lambda c: F.aggregate(c, start, step)), start))[0]
        within = F.zip_with(chunks, bases, lambda c, b: F.when(c.isNotNull(), F.slice(before(c, b), 1, F.size(c))))
        return F.flatten(F.filter(within, lambda w: w.isNotNull()))

    none = F.array().cast("array<bigint>")
    return F.transform(F.array(values), lambda v: F.when(F.size(v) > 0, of(v)).otherwise(none))[0]


def _of_kind(text: Column, kind: Kind, rank: int) -> Column:
    """The confirmed spans of one kind."""
    empty = F.array().cast(SPANS)

    def places(hits: Column) -> Column:
        def build(parts: Column) -> Column:
            lengths = F.transform(hits, lambda h, i: (F.length(F.get(parts, i)) + F.length(h)).cast("bigint"))
            ends = running(lengths, lambda a, v: a + v, F.lit(0).cast("bigint"))
            near = lambda i: F.concat(
                F.right(F.get(parts, i), F.lit(CONTEXT)), F.lit(" "), F.left(F.get(parts, i + 1), F.lit(CONTEXT))
            )
            raised = lambda i: near(i).rlike(rf"(?i)\b(?:{kind.words})")
            each = F.zip_with(hits, ends, lambda h, e: F.struct(h.alias("value"), e.alias("before")))
            numbered = F.transform(each, lambda x, i: F.struct(x["value"].alias("value"), (x["before"] + F.length(F.get(parts, i))).alias("s"), i.alias("i")))
            return F.transform(
                F.filter(numbered, lambda x: kind.valid(x["value"])),
                lambda x: F.struct(
                    x["s"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"),
                    (x["s"] + F.length(x["value"])).alias("end"), x["value"].alias("value"),
                    F.when(raised(x["i"]), min(1.0, kind.score + 0.2)).otherwise(kind.score).alias("score"),
                ),
            )

        return F.transform(F.array(F.split(text, kind.pattern, -1)), build)[0]

    hits = F.array(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)))
    found = F.transform(hits, lambda h: F.when(F.size(h) > 0, places(h)).otherwise(empty))[0]
    return F.when(kind.quick(text), found.cast(SPANS)).otherwise(empty)


def spans(text: Column, kinds: tuple[Kind, ...] = KINDS, least_score: float = LEAST_SCORE) -> Column:
    """All spans of a text by start, then by the order of ``kinds``."""
    every = F.concat(*[_of_kind(text, k, i) for i, k in enumerate(kinds)])
    base = [i for i, k in enumerate(kinds) if k.base]
    kept = F.filter(every, lambda s: s["rank"].isin(base) | (s["score"] >= least_score))
    return F.coalesce(F.array_sort(kept), F.array().cast(SPANS))


def listed(found: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document with counts and a digest of the base kinds and the list of spans."""
    base = [k.name for k in KINDS if k.base]
    found = docs.select(F.col(doc_id).alias("doc_id"), spans(F.col(text)).alias("s"))
    count = lambda kind: F.size(F.filter("s", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(listed(F.filter("s", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("s")).alias("spans"),
        F.coalesce(F.array_max(F.transform("s", lambda s: s["score"])), F.lit(0.0)).alias("highest_score"),
    )


def redacted(text: Column, found: Column) -> Column:
    """``text`` with the union of its spans masked as ``<KIND>``, the kind of the first span.

    A span that starts at or behind the end of all before it opens a mask; the next one tells where it ends.
    """
    zero = F.lit(0).cast("bigint")
    longest = lambda a, v: F.greatest(a, v)
    ends = F.transform(found, lambda s: s["end"])

    def opened(behind: Column) -> Column:
        each = F.zip_with(found, behind, lambda s, b: F.struct(b.alias("from"), s["start"].alias("start"), s["kind"].alias("kind")))
        return F.filter(each, lambda x: x["start"] >= x["from"])

    def chunk(cs: Column) -> Column:
        base, last = cs[0]["from"], F.element_at(cs, -1)["start"]
        part = F.array(F.substr(text, base.cast("int") + 1, (last - base).cast("int")))
        pieces = lambda p: F.transform(
            cs, lambda x: F.concat(F.substr(p, (x["from"] - base).cast("int") + 1, (x["start"] - x["from"]).cast("int")), F.lit("<"), F.upper(x["kind"]), F.lit(">"))
        )
        return F.transform(part, lambda p: F.array_join(pieces(p), ""))[0]

    def rebuilt(heads: Column) -> Column:
        count = F.floor((F.size(heads) - 1) / CHUNK).cast("int")
        parts = F.transform(F.sequence(F.lit(0), count), lambda c: chunk(F.slice(heads, c * CHUNK + 1, F.lit(CHUNK))))
        return F.concat(F.array_join(parts, ""), F.substr(text, F.array_max(ends).cast("int") + 1))

    heads = F.transform(F.array(running(ends, longest, zero)), opened)
    return F.transform(heads, lambda hs: F.when(F.size(hs) > 0, rebuilt(hs)).otherwise(text))[0]


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the spans of ``text`` masked; null texts stay null."""
    (found,) = unused(docs, "found_spans")
    seen = docs.withColumn(found, spans(F.col(text)))
    return seen.withColumn(text, redacted(F.col(text), F.col(found))).drop(found)
