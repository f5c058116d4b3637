"""Language and toxicity models: held-out accuracy, plain Python versions, odd texts and empty tables."""

import math
import re
from collections import Counter

from pathlib import Path

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwork.llm import langid, queries, toxicity
from siftwork.llm.common import held_out

DATA = Path("/root/testdata/sf0.01")
here = pytest.mark.skipif(not DATA.exists(), reason="the tables aren't here")


@here
def test_language_of_held_out_documents(spark):
    lang = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    rows = queries.op1_language_id(spark, str(DATA)).filter("held_out").join(lang, "doc_id").filter("lang is not null").collect()
    assert len(rows) > 150 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)


def test_language_of_odd_texts(spark, docs, none):
    train = spark.createDataFrame(
        [(1, "the house is old and the river", "en"), (2, "das haus ist alt und der fluss", "de"), (3, None, "en"), (4, "le chat", None)],
        "doc_id long, text string, lang string",
    )
    model = langid.fit(train, F.lit(True))
    assert model.languages == ["de", "en"]
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect() if r["doc_id"] is not None}
    assert [got[i]["lang_pred"] for i in range(6)] == ["und", "und", "und", "und", got[4]["lang_pred"], "en"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[0]["score"] == 0
    assert langid.identify(docs, langid.fit(none, ~held_out())).filter("lang_pred <> 'und'").isEmpty()
    assert langid.identify(none, model).isEmpty()


def test_unknown_words_back_off_to_character_ngrams():
    words, grams = {"haus": ((0, 8.0),)}, {"aus$": ((0, 4.0),), "a": ((0, 2.0), (1, 2.0))}
    model = langid.LanguageModel(["de", "en"], [-0.7, -0.7], {n: [-9.0 + n] * 2 for n in range(6)}, words, grams)
    scorer = langid.Scorer(model)
    assert scorer.word("haus") == (-1.0, -9.0)
    assert scorer.word("maus") == (-1.0, -5.0) and scorer.word("ab") == (-6.0, -6.0) and scorer.word("zz") == (0.0, 0.0)


def test_language_scores_equal_plain_counts(spark):
    """Words and n-grams counted and scored anew, for three languages of which one is rare."""
    train = {"aa": ["lama dala lama kala", "lama lama dala kala kala dala"] * 3, "bb": ["dorn korn lama", "korn korn dorn dorn"] * 4, "cc": ["misi misi misi tisi"]}
    rows = [(f"{c}{i}", t, c) for c, ts in train.items() for i, t in enumerate(ts)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id string, text string, lang string"), F.lit(True))
    words = {c: Counter(w for t in ts for w in t.split()) for c, ts in train.items()}
    grams = {n: {c: Counter() for c in train} for n in langid.ORDERS}
    for c, ws in words.items():
        for w, k in ws.items():
            for n in langid.ORDERS:
                for i in range(len(w) + 3 - n):
                    grams[n][c][f"^{w}$"[i : i + n]] += k
    often = lambda table: {c: {t: k for t, k in ts.items() if k >= langid.LEAST_COUNT} for c, ts in table.items()}

    def log_share(table, term):
        size = len({t for ts in table.values() for t in ts})
        return [math.log((table[c].get(term, 0) + 0.5) / (sum(table[c].values()) + 0.5 * (size + 1))) for c in sorted(table)]

    def score(word):
        if any(word in ts for ts in often(words).values()):
            return log_share(often(words), word)
        for n in langid.ORDERS:
            table, own = often(grams[n]), [f"^{word}$"[i : i + n] for i in range(len(word) + 3 - n)]
            if hit := [g for g in own if any(g in ts for ts in table.values())]:
                return [sum(x) / len(hit) for x in zip(*(log_share(table, g) for g in hit))]
        return [0.0] * 3

    assert model.languages == ["aa", "bb", "cc"]
    for word in ("lama", "korn", "misi", "tisi", "lamadorn", "xx", "malam"):
        assert langid.Scorer(model).word(word) == pytest.approx(score(word)), word


@pytest.fixture(scope="module")
def insults(spark):
    """Ordinary prose of a few words; every fifth text also has insults."""
    words = "the old house near river bank was seen today by many people walking with their dogs under trees".split()
    rows = []
    for i in range(600):
        text = " ".join(words[(i * 7 + k * (1 + i % 5)) % len(words)] for k in range(40))
        rows.append((i, text + (" you blithering nincompoop" if i % 5 == 0 else f" number{i}"), int(i % 5 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_finds_held_out_insults(spark, insults, docs, none):
    model = toxicity.fit(insults.select("doc_id", "text"), insults.select("doc_id", "toxic"), ~held_out())
    rows = toxicity.score(insults, model).join(insults.select("doc_id", "toxic"), "doc_id").filter(held_out()).collect()
    assert rows and all(r["predicted"] == r["toxic"] for r in rows)
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == docs.count() and all(r["score"] is not None and 0 <= r["score"] <= 1 for r in odd)
    assert {r["score"] for r in odd if r["doc_id"] in (0, 1, 2)} == {0.0}
    assert toxicity.score(none, model).isEmpty()
    assert toxicity.fit(docs, insults.filter("toxic = 0"), F.lit(True)) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}


def test_gains_equal_two_plain_compressions():
    """Windows cut and compressed anew; text without a stretch of the toxic dictionary gains little."""
    ordinary, toxic = b" the old house near the river bank was seen today ", b" blithering  nincompoop "
    text = "The old house near the river; BLITHERING fool! " * 3 + "nincompoop"
    spaced, cut = " " + " ".join(re.findall(r"\w+", text.lower())) + " ", []
    while len(spaced) > 1:
        k = spaced.find(" ", toxicity.WINDOW)
        k = len(spaced) - 1 if k < 0 else k
        cut.append(spaced[: k + 1])
        spaced = spaced[k:]
    assert toxicity.windows(text) == [w.encode() for w in cut] and all(len(w) > toxicity.WINDOW for w in cut[:-1])
    c = toxicity.Compressors(ordinary, toxic)
    want = [len(c.ordinary.compress(w.encode() + toxicity.END)) - len(c.toxic.compress(w.encode() + toxicity.END)) for w in cut]
    assert c.gains(text) == want and max(want) >= 5
    assert max(c.gains("The old house near the river bank. " * 20)) <= 1
    assert toxicity.rate_of([5, 0, 2, -1], 1) == 5 / (4 + toxicity.SPARE_WINDOWS)


def test_stretches_are_what_telling_runs_cover():
    assert toxicity.stretches("pathetic", {" pathe", "thetic", "hetic "}) == [" pathetic "]
    assert toxicity.stretches("scum", {" scum "}) == [" scum "] and toxicity.stretches("scum", set()) == []
    assert toxicity.stretches("abcdefghijklmnop", {" abcde", "klmnop"}) == [" abcde", "klmnop"]
    assert toxicity.stretches("abcdefghijk", {" abcde", "fghijk"}) == [" abcdefghijk"]


@given(st.text("aßé語😀", min_size=1, max_size=12))
def test_runs_are_the_shortest_of_enough_bytes(spaced):
    size = lambda i, j: len(spaced[i:j].encode())
    want = [
        (i, j) for i in range(len(spaced)) for j in range(i + 1, len(spaced) + 1)
        if size(i, j) >= toxicity.GRAM > size(i, j - 1)
    ]
    assert toxicity.runs(spaced) == (want or [(0, len(spaced))])


def test_evidence_of_a_run(spark):
    seen = [(6, 0), (3, 0), (16, 1), (1, 9), (0, 4)]
    got = spark.createDataFrame(seen, "a long, b long").select(toxicity.evidence(F.col("a"), F.col("b"), 30, 270).alias("g"))
    for (a, b), r in zip(seen, got.collect()):
        want = 2 * sum(n * math.log(n / ((a + b) * p)) for n, p in ((a, 0.1), (b, 0.9)) if n) if a > (a + b) * 0.1 else 0
        assert r["g"] == pytest.approx(want)


def test_both_dictionaries_come_from_the_trainer(spark, insults):
    model = toxicity.fit(insults.select("doc_id", "text"), insults.select("doc_id", "toxic"), F.lit(True))
    assert b"blithering" in model.toxic and b"nincompoop" in model.toxic and b"blithering" not in model.ordinary
    unseen = spark.createDataFrame([(1, "the old house and a blitheringly dull river near the bank"), (2, "the old house and a river near the bank")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_toxic"] for r in toxicity.score(unseen, model).collect()}
    assert got[1] > got[2] == 0


def test_calibration_takes_the_rate_between_the_classes():
    rows = [([0.2] * len(toxicity.FLOORS), 1)] * 3 + [([0.1] * len(toxicity.FLOORS), 0)] * 5
    assert toxicity.calibrate(rows) == (1.0, toxicity.FLOORS[0], pytest.approx(0.15))


def test_only_drawn_texts_are_shuffled(spark, tmp_path):
    from siftwork.llm import toxicity

    docs = spark.range(100).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    drawn = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (500, 1), (None, 1)], "id long, y int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = toxicity.texts_of(docs, drawn)
        assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["id"], r["text"], r["y"]) for r in found.collect()) == [(1, "t1", 0), (2, "t2", 0), (2, "t2", 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
