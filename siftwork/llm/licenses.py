"""Licence phrases and licence templates in document texts, with DataFrame functions only.

Base: the places where a phrase's words stand consecutively. Method: an exact set-similarity
join of text blocks with licence templates, which are sentences of notices. Blocks are windows of
a text's words across line breaks, of a size tied to the template: for a template of ``n`` words
they start at every ``n / 2`` words and are that much longer than it, so each run of ``n`` words is
in one, and no block is longer than half as much again. A block is compared with templates of its
length only and matches if it contains at least ``threshold`` of the template's distinct words. A
text whose words as a whole are too few for every template has no block that matches, and is left
out.
Words that name a licence tell it from its rivals, whose notices read alike but for them: a template
with a name matches only blocks in which the name's words stand in a row.

Words are ordered by their frequency over all blocks, rarest first. A block and a template that
need ``o`` words in common must share one within their first ``size - o + 1`` words (prefix
filter), blocks with fewer than ``o`` template words can't match (length filter), and a shared
word whose positions leave fewer than ``o`` words after it in either is no candidate
(positional filter). Words that no template has are left out of the block's set: they can't be
part of an overlap, so positions and sizes count template words only.

Cases: a null text is empty and has no word, place or label. Matching ignores the case of A-Z
only. Repeated rows each get their result. Blocks and texts are used whole at any length. Equal
frequencies are ordered by the word. An empty table gives an empty result, and other columns are
ignored, whatever their names. Without a match ``labels`` is the base labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Phrases with the labels they give.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Words of the notices that licences ask to be put on a work.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program if not see"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "released under the bsd license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("mpl", "licensed under the mozilla public license version 2 0"),
    ("epl", "licensed under the eclipse public license version 2 0"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Words of a template that name its licence. They must stand in a block, in a row.
NAMES = {
    "released under the mit license": "mit license",
    "licensed under the apache license version 2 0": "apache license",
    "this work is licensed under the gnu general public license version 3": "gnu general public license",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gnu general public license",
    "you should have received a copy of the gnu general public license along with this program if not see": "gnu general public license",
    "licensed under cc by nc 4 0": "cc by nc",
    "this work is licensed under a creative commons attribution 4 0 international license": "creative commons attribution 4 0",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mozilla public license",
    "released under the bsd license": "bsd license",
    "licensed under cc by 4 0": "cc by 4 0",
    "licensed under cc by sa 4 0": "cc by sa",
    "licensed under the mozilla public license version 2 0": "mozilla public license",
    "licensed under the eclipse public license version 2 0": "eclipse public license",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lesser general public license",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license": "affero general public license",
    "this is free and unencumbered software released into the public domain": "unencumbered software",
}
THRESHOLD = 0.8
#: A word of the original text; its lower-case form is a word of the lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def phrase_places(text: Column) -> Column:
    """An array of ``label, word`` for each place of a phrase; null text gives none.

    Only texts that have every word of some phrase are taken apart.
    """
    maybe = F.lit(False)
    for phrase, _ in PHRASES:
        has = F.lit(True)
        for w in phrase.split():
            has &= text.rlike(f"(?i){w}")
        maybe |= has
    words = _words(text)

    # one pass over the word positions; the words themselves are computed once, as an argument
    ends = F.transform(
        F.array(words),
        lambda ws: F.filter(
            F.transform(ws, lambda w, i: F.struct(_phrase_at(ws, i).alias("label"), i.cast("long").alias("word"))),
            lambda p: p["label"].isNotNull(),
        ),
    )
    none = F.array().cast("array<struct<label:string,word:bigint>>")
    return F.when(maybe, ends[0]).otherwise(none)


def _phrase_at(words: Column, i: Column) -> Column:
    found = F.lit(None).cast("string")
    for phrase, label in reversed(PHRASES):
        same = F.lit(True)
        for k, w in enumerate(phrase.split()):
            same &= F.get(words, i + k) == w
        found = F.when(same, F.lit(label)).otherwise(found)
    return found


def blocks(docs: DataFrame, doc_id: str, text: str, templates: tuple[tuple[str, str], ...], threshold: float) -> DataFrame:
    """``doc_id, text_hash, width, words, names`` of the blocks that may match, each once a document.

    ``width`` is the number of words of the templates that a window is for, ``names`` are the names of
    templates that stand in it.
    A document is known by its id and the hash of its text.
    """
    vocabulary = F.array(*map(F.lit, sorted({w for _, t in templates for w in t.split()})))
    sets = [(len(t.split()), sorted(set(t.split()))) for _, t in templates]
    needs = [_needed(len(ws), threshold) for _, ws in sets]
    # lengths of the templates that the whole text has words enough for; its words are computed once, as an argument
    fits = lambda own: F.array(*[
        F.when(F.size(F.array_intersect(own, F.array(*map(F.lit, ws)))) >= need, F.lit(n)) for (n, ws), need in zip(sets, needs)
    ])
    none = F.array().cast("array<int>")
    widths = F.transform(
        F.array(F.array_intersect(_words(F.col(text)), vocabulary)),
        lambda own: F.when(F.size(own) >= min(needs), F.array_distinct(F.array_compact(fits(own)))).otherwise(none),
    )[0]
    read = (
        docs.filter(F.col(text).isNotNull())
        .select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), widths.alias("widths"))
        .filter(F.size("widths") > 0)
        .withColumn("text_hash", F.xxhash64("text"))
    )
    step = F.ceil(F.col("width") / 2).cast("int")
    windows = (
        read.select("doc_id", "text_hash", _words(F.col("text")).alias("all"), F.explode("widths").alias("width"))
        .select("doc_id", "text_hash", "width", "all", F.explode(F.sequence(F.lit(0), F.size("all") - 1, step)).alias("at"))
        .select("doc_id", "text_hash", "width", F.slice("all", F.col("at") + 1, F.col("width") + step).alias("run"))
    )
    line = F.concat(F.lit(" "), F.array_join("run", " "), F.lit(" "))
    names = sorted({NAMES[t] for _, t in templates if t in NAMES})
    standing = F.array_compact(F.array(*[F.when(F.contains("line", F.lit(f" {n} ")), F.lit(n)) for n in names])) if names else F.array().cast("array<string>")
    return (
        windows.select("doc_id", "text_hash", "width", "run", F.array_intersect("run", vocabulary).alias("words"))
        .filter(F.size("words") >= min(needs))
        .withColumn("line", line)
        .select("doc_id", "text_hash", "width", "words", standing.alias("names"))
        .distinct()
    )


def similarity_join(
    found: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """``doc_id, text_hash, label`` and the best containment for blocks that match a template."""
    spark = found.sparkSession
    counts = found.select(F.explode("words").alias("w")).groupBy("w").count()
    # at most one row for each word of the templates
    frequency = {r["w"]: r["count"] for r in counts.collect()}
    rows = []
    for k, (label, words) in enumerate(templates):
        ordered = sorted(set(words.split()), key=lambda w: (frequency.get(w, 0), w))
        need = _needed(len(ordered), threshold)
        rows += [(k, label, len(words.split()), ordered, need, NAMES.get(words), w, i) for i, w in enumerate(ordered[: len(ordered) - need + 1])]
    index = spark.createDataFrame(
        rows, "template int, label string, template_width int, template_words array<string>, need int, name string, w string, template_at int"
    )
    least = min(r[4] for r in rows)
    order = F.create_map(*[F.lit(x) for w in sorted({w for _, t in templates for w in t.split()}, key=lambda w: (frequency.get(w, 0), w)) for x in (w, frequency.get(w, 0))])
    ranked = F.array_sort(F.transform("words", lambda w: F.struct(F.try_element_at(order, w).alias("n"), w.alias("w"))))
    prefixed = found.withColumn("words", F.transform(ranked, lambda x: x["w"])).select(
        "doc_id", "text_hash", "width", "words", "names",
        F.posexplode(F.slice("words", 1, F.size("words") - least + 1)).alias("block_at", "w"),
    )
    # the index has one row for each prefix word of the fixed templates
    candidates = (
        prefixed.join(F.broadcast(index), "w")
        .filter(F.col("width") == F.col("template_width"))
        .filter(F.col("name").isNull() | F.array_contains("names", F.col("name")))
        .filter(F.size("words") >= F.col("need"))
        .filter(1 + F.least(F.size("words") - 1 - F.col("block_at"), F.size("template_words") - 1 - F.col("template_at")) >= F.col("need"))
    )
    shared = F.size(F.array_intersect("words", "template_words"))
    return (
        candidates.withColumn("containment", shared / F.size("template_words"))
        .filter(shared >= F.col("need"))
        .groupBy("doc_id", "text_hash", "label")
        .agg(F.max("containment").alias("containment"))
    )


def _needed(size: int, threshold: float) -> int:
    """The least number of words in common that reaches the threshold."""
    need = int(size * threshold)
    return need if need / size >= threshold else need + 1


def scan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD,
) -> DataFrame:
    """A row for each document with its places, labels and a score.

    ``score`` is the best containment of a template, at least 0.9 where a phrase stands, else 0.
    """
    matched = (
        similarity_join(checkpointed(blocks(docs, doc_id, text, templates, threshold)), templates, threshold)
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment"))
        .withColumnsRenamed({"doc_id": "m_id", "text_hash": "m_hash"})
    )
    base = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"),
        phrase_places(F.col(text)).alias("places"),
    )
    own = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    all_labels = F.array_sort(F.array_union(own, F.coalesce("found", F.array().cast("array<string>"))))
    joined = base.join(matched, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash")), "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["word"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["word"])).alias("last_word"),
        F.array_join(own, ",").alias("base_labels"),
        F.array_join(all_labels, ",").alias("labels"),
        F.greatest(F.coalesce("containment", F.lit(0.0)), F.when(F.size("places") > 0, 0.9).otherwise(0.0)).alias("score"),
    )
