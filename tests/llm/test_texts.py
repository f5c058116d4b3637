"""Licence, quality, personal-data and token operators against plain Python over odd texts."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftwork.llm import licenses, pii, quality, tokens

PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def by_text(rows, docs):
    """Result rows of non-null ids by id; every row of the input has one."""
    assert len(rows) == docs.count()
    return {r["doc_id"]: r for r in rows if r["doc_id"] is not None}


def test_licence_places(docs, texts):
    got = by_text(licenses.scan(docs).collect(), docs)
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        found = [(k, label) for p, label in PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        places = [k for k, _ in found]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(found))
        assert (r["first_word"], r["last_word"]) == (min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in found}))
        assert {*r["base_labels"].split(",")} - {""} <= {*r["labels"].split(",")} and 0 <= r["score"] <= 1


def test_licence_similarity_join_equals_all_pairs(spark):
    templates = (("a", "alpha beta gamma delta epsilon"), ("b", "beta zeta eta theta"), ("c", "iota"))
    lines = ["alpha beta gamma delta", "alpha beta gamma", "theta eta zeta beta beta x", "zeta eta theta\niota iota", "eta beta zeta", ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    got = {r["doc_id"]: {*filter(None, r["labels"].split(","))} for r in licenses.scan(docs, templates=templates).collect()}
    for i, t in enumerate(lines):
        words, held = t.split(), set()
        for label, template in templates:
            n, own = len(template.split()), set(template.split())
            step = -(-n // 2)
            blocks = [set(words[k : k + n + step]) for k in range(0, len(words), step)]
            held |= {label for b in blocks if len(b & own) / len(own) >= 0.8}
        assert got[i] == held


def test_words_of_a_template_far_apart_are_no_licence(spark):
    spread = "a deed the person who has a public work in the old domain " + "of the house by the lake " * 20 + "dedicated to this associated with public domain"
    notice = next(t for label, t in licenses.TEMPLATES if label == "cc0")
    docs = spark.createDataFrame([(1, spread), (2, "x y " * 400 + notice + " z" * 400)], "doc_id long, text string")
    assert {r["doc_id"]: r["labels"] for r in licenses.scan(docs).collect()} == {1: "", 2: "cc0"}


def test_wrapped_licences_have_their_labels(spark):
    """Every notice alone, hard-wrapped, in comments, across blank lines and amid other words; parts far apart aren't one."""
    rows, want = [], []
    for label, words in licenses.TEMPLATES:
        ws = words.split()
        for width in (3, 5, 9, 99):
            lines = [" ".join(ws[k : k + width]) for k in range(0, len(ws), width)]
            for text in ("\n".join(lines), "\r\n".join(f" * {x}" for x in lines), "\n\n".join(lines), "other words\n" * 333 + "\n".join(lines) + "\nmore words" * 33):
                rows.append(text)
                want.append(label)
    apart = ("\n" + "filler\n" * 200 + "\n").join(next(t for label, t in licenses.TEMPLATES if label == "bsd").split())
    docs = spark.createDataFrame([*enumerate(rows), (len(rows), apart)], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(docs).collect()}
    assert all(label in got[i] for i, label in enumerate(want)) and got[len(rows)] == [""]
    beside = "der den mit.\nEiner im dem. Und das ist alles hier.\nLicensed under the Apache License, Version 2.0."
    only = licenses.scan(spark.createDataFrame([(1, beside)], "doc_id long, text string")).collect()
    assert [r["labels"] for r in only] == ["apache"]


def test_licences_of_no_rows(none):
    assert licenses.scan(none).collect() == []


def repeated(words):
    grams = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    return len({k + j for k in range(len(words) - 4) if grams[tuple(words[k : k + 5])] > 1 for j in range(5)})


def test_quality_counts(docs, texts):
    got = by_text(quality.judge(docs).collect(), docs)
    for i, t in enumerate(texts):
        t, r, seen, doubled = t or "", got[i], set(), 0
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                doubled += line in seen
                seen.add(line)
        symbols = len(re.findall(r"[#*$%&|<>]", t))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (len(words), sum(map(len, words)), symbols, doubled)
        assert r["n_repeat_words"] == repeated(words)
        assert r["base_failed"] == (len(words) < 10 or 100 * repeated(words) > 20 * len(words))
        assert not (r["base_failed"] and r["kept"])


def test_quality_shrinks_small_hosts(spark, none):
    good, bad = "good words that say a thing once and for all in a line", "bad"
    rows = [("small", bad)] + [("large", good)] * 90 + [("large", bad)] * 10 + [("worst", bad)] * 60 + [("worst", good)] * 2
    docs = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    rates = {r["source"]: r["rate"] for r in quality.judge(docs).join(docs, "doc_id").groupBy("source").agg(F.first("host_rate").alias("rate")).collect()}
    failures = {"small": (1, 1), "large": (10, 100), "worst": (60, 62)}
    mean = 71 / 163
    between = sum(f * f / n for f, n in failures.values()) / 163 - mean**2 - mean * (1 - mean) * 3 / 163
    weight = max(2.0, mean * (1 - mean) / between - 1)
    assert rates == pytest.approx({h: (f + mean * weight) / (n + weight) for h, (f, n) in failures.items()})
    limit = max(0.25, mean + (mean * (1 - mean) / (weight + 1)) ** 0.5)
    assert rates["small"] < 1 and rates["worst"] > limit > rates["large"]
    kept = quality.judge(docs).join(docs, "doc_id").filter("kept").groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in kept} == {"large": 90}
    good_of_worst = quality.judge(docs).join(docs, "doc_id").filter("source = 'worst' and not base_failed").select("kept").collect()
    assert [r["kept"] for r in good_of_worst] == [False, False]
    assert quality.judge(none).collect() == []


def test_every_rule_can_reject_a_host(spark):
    """Hosts that fail one rule each; documents that fail it elsewhere stay."""
    plain = "good words that say a thing once and for all in a line of number {}"
    spoiled = {"symbols": plain + " # * $ %", "lines": "same old line\n" * 2 + plain + "\nsame old line", "lengths": " ".join(["incomprehensibilities{}"] + [c * 14 for c in "abcdefghijkl"])}
    rows = [(name, text.format(k)) for name, text in spoiled.items() for k in range(40)]
    rows += [(f"h{h}", plain.format(k)) for h in range(12) for k in range(40)] + [(f"h{h}", spoiled["symbols"].format(h)) for h in range(3)]
    docs = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    got = quality.judge(docs).join(docs, "doc_id")
    assert got.filter("base_failed").isEmpty()
    assert {r["source"] for r in got.filter("not kept").select("source").distinct().collect()} == set(spoiled)
    assert {r["source"]: r["rules_failed"] for r in got.filter("not kept").select("source", "rules_failed").distinct().collect()} == {n: n for n in spoiled}
    alike = quality.judge(docs.filter("source like 'h%'"))
    assert alike.filter("not kept").isEmpty()


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(digits[::-1])) % 10 == 0


def base_spans(t):
    found = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)] if t.count("@") < 999 else []
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t if "." in t else ""):
        if all(int(x) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, "phone", m.end()))
    return sorted(found)


def test_personal_data_base(docs, none, texts):
    got = by_text(pii.detect(docs).collect(), docs)
    for i, t in enumerate(texts):
        spans = base_spans(t or "")
        listed = ",".join(f"{kind}:{a}:{z}" for a, _, kind, z in spans)
        n = Counter(kind for _, _, kind, _ in spans)
        r = got[i]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [n[k] for k in ("email", "ip", "card", "phone")], t[:80]
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert {*listed.split(",")} - {""} <= {*r["spans"].split(",")}
    assert pii.detect(none).collect() == []


def test_personal_data_of_the_method_and_masks(spark):
    texts = ["bank iban GB82 WEST 1234 5698 7654 32 ok", "iban GB82 WEST 1234 5698 7654 33", "my social security number is 123-45-6789.", "part 123-45-6789", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.detect(docs).collect()}
    assert "iban:10:37" in spans[0] and "iban" not in spans[1] and "ssn:29:40" in spans[2] and "ssn" not in spans[3]
    masked = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert masked[2] == "my social security number is <SSN>." and masked[4] is None and "WEST" not in masked[0]


@pytest.mark.parametrize("rule", tokens.RULES)
def test_tokens_add_up(spark, rule):
    texts = [None, "", "\n", "one line", "two\nlines of text\n\n\nand naïve 𝒳 字", "x\n" * 500 + "   \n   tail"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    path, pattern = tokens.default_vocabulary()
    encoder = tokens.Encoder(open(path, "rb").read(), pattern)
    rows = tokens.section_tokens(docs, rule=rule).orderBy("doc_id", "section").collect()
    for i, t in enumerate(texts):
        own = [r for r in rows if r["doc_id"] == i]
        assert sum(r["n_tokens"] for r in own) == pytest.approx(len(encoder.coder.encode_ordinary(t or "")))
        assert "".join((t or "")[r["start"] : r["end"]] for r in own) == (t or "")


def plain_sections(text, starts, spans, rule):
    """Tokens and crossing tokens of each section, token by token."""
    ends = [*starts[1:], len(text)]
    tokens, crossing = [0.0] * len(starts), [0] * len(starts)
    for a, b in spans:
        share = [max(0, min(b, z) - max(a, s)) for s, z in zip(starts, ends)]
        own = [k for k, n in enumerate(share) if n]
        for k in own:
            crossing[k] += len(own) > 1
        if rule == "split":
            for k in own:
                tokens[k] += share[k] / sum(share)
        else:
            tokens[{"start": own[0], "end": own[-1], "most": max(own, key=lambda k: (share[k], -k))}[rule]] += 1
    return tokens, crossing


@pytest.mark.parametrize("rule", tokens.RULES)
def test_sections_equal_plain_attribution(spark, docs, texts, rule):
    """Odd and long texts, repeated rows, null ids and taken names; then sections that cut through tokens."""
    path, pattern = tokens.default_vocabulary()
    encoder = tokens.Encoder(open(path, "rb").read(), pattern)
    rows = tokens.section_tokens(docs, rule=rule).collect()
    assert {r["doc_id"] for r in rows} == {*range(len(texts)), None} and sum(r["doc_id"] == 5 for r in rows) == 2
    cut = [(i, t, sorted({0, *range(3, len(t), 7)})) for i, t in enumerate(texts) if t and len(t) < 500]
    table = spark.createDataFrame(cut, "doc_id long, text string, cuts array<int>")
    got = {}
    for r in tokens.section_tokens(table, rule=rule, starts="cuts").orderBy("doc_id", "section").collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t, starts in cut:
        begin, end, _ = encoder.spans(t)
        n, crossing = plain_sections(t, starts, list(zip(begin.tolist(), end.tolist())), rule)
        assert [r["n_tokens"] for r in got[i]] == pytest.approx(n) and [r["n_crossing"] for r in got[i]] == crossing


def test_fields_share_one_encoding(spark):
    table = spark.createDataFrame([(1, "A title", "Body text here.", None), (2, None, None, None), (3, "x" * 50, "", "end")], "doc_id long, title string, body string, note string")
    path, pattern = tokens.default_vocabulary()
    encoder = tokens.Encoder(open(path, "rb").read(), pattern)
    rows = tokens.field_tokens(table, ["title", "body", "note"]).collect()
    assert len(rows) == 9
    whole = {1: "A title\n\nBody text here.\n\n", 2: "\n\n\n\n", 3: "x" * 50 + "\n\n\n\nend"}
    for i, t in whole.items():
        assert sum(r["n_tokens"] for r in rows if r["doc_id"] == i) == len(encoder.coder.encode_ordinary(t))
    assert {r["field"]: r["n_tokens"] for r in rows if r["doc_id"] == 1}["body"] >= 4


def test_masks_of_overlapping_and_many_spans(spark):
    """Spans of several kinds that overlap, and more of them than a chunk has."""
    many = " ".join(f"a{k}@b.example +49 30 {k:07d}x" for k in range(700))
    texts = ["call +4111 1111 1111 1111 now", many, "a@b.c", "none"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [x.split(":") for x in r["spans"].split(",") if x] for r in pii.detect(docs).collect()}
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    for i, t in enumerate(texts):
        out, upto = "", 0
        for kind, a, z in found[i]:
            a, z = int(a), int(z)
            if a >= upto:
                out += t[upto:a] + f"<{kind.upper()}>"
            upto = max(upto, z)
        assert got[i] == out + t[upto:]
    assert len(found[1]) == 1400


def test_tokens_of_no_rows(none):
    assert tokens.section_tokens(none).collect() == []


def test_rivals_of_a_license_give_no_false_label(spark):
    """Notices that differ from a template by the word that tells licences apart."""
    notices = {
        "released under the Apache License": "apache",
        "released under the BSD license": "bsd",
        "The data is licensed under CC BY 4.0.": "cc-by",
        "The data is licensed under CC BY-SA 4.0.": "cc-by-sa",
        "The data is licensed under CC BY-NC 4.0.": "cc-by-nc",
        "Licensed under the Mozilla (or Eclipse) Public License version 2.0": "epl",
        "Licensed under the Mozilla Public License, version 2.0": "mpl",
        "Licensed under the Eclipse Public License, version 2.0": "epl",
        "the file was released on the license under debate": "",
        "released under the Foo license": "",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "",
        "Released under the MIT License.": "mit",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License": "gpl,lgpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License": "agpl,gpl",
    }
    docs = spark.createDataFrame(list(enumerate(notices)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(docs).collect()}
    assert got == dict(enumerate(notices.values()))
